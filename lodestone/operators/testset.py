"""Building a test set: passages worth asking about, questions from a model, quotes found again in their paragraphs, review.

Draws are by hashes of a seed and the row's own key, so that a run that is taken up again draws the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.grams import QuoteGrams
from ..functions.python import located_quote, near_quote, normal_form
from ..session import spread
from .retrieval import blocks

EVIDENCE = "array<struct<doc_id:string,quote:string,para:string,page:int>>"
SINGLE = "Write one question that this passage answers, its answer, and the sentence of the passage that proves it, word for word. Reply as JSON: question, answer, question_type, evidence_quote; or skip.\n\n"
#: Paragraphs of a batch that are Python strings at once.
LINES = 1_024
MULTI = "Write one question that needs both passages, its answer, and from each the sentence that proves it, word for word. Reply as JSON: question, answer, evidence_a, evidence_b; or skip.\n\n"
PARAPHRASE = "Ask the same in everyday words; keep every condition. Reply as JSON: question.\n\nQuestion: "


def useful(section: Column, text: Column) -> Column:
    """Passages worth a question: not of a section on repeals, not a list of circulars, with a figure or an obligation."""
    low = F.lower(text)
    boring = F.lower(section).contains("repeal") | (F.regexp_count(low, F.lit("circular")) > 4)
    return ~boring & (low.rlike(r"(?U)\d") | low.contains("shall"))


def drawn(seed: int, *key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key)))


def pick_passages(passages: DataFrame, n: int, seed: int = 7, doc: str = "doc_id", chapter: str = "chapter", key: str = "passage_no") -> DataFrame:
    """``n`` passages of each document: in the drawn order, the first of every chapter before any second one. ``pick`` is their turn."""
    order = drawn(seed, F.col(doc), F.col(key))
    of_chapter = F.row_number().over(Window.partitionBy(doc, chapter).orderBy("order", key))
    ranked = passages.withColumn("order", order).withColumn("again", (of_chapter > 1).cast("int"))
    pick = F.row_number().over(Window.partitionBy(doc).orderBy("again", "order", key))
    return ranked.withColumn("pick", pick).where(F.col("pick") <= n).drop("order", "again")


def evidence_for(asked: DataFrame, paras: DataFrame) -> DataFrame:
    """(item, doc_id, quote, para, page): where each quote of ``asked`` (item, doc_id, passage_no, text, quote) stands, in the passage's own words.

    ``paras``: doc_id, passage_no, seq, text, para, page_start of the passages' paragraphs. The paragraph is the first that holds the quote's
    first 60 characters, else the passage's first; quotes that the passage does not say have no row."""
    found = asked.withColumn("exact", located_quote("quote", "text")).where("exact IS NOT NULL").select("item", "doc_id", "passage_no", "exact")
    held = F.contains(normal_form(F.col("text")), F.substring("exact", 1, 60))
    both = found.join(paras.select("doc_id", "passage_no", "seq", "text", "para", "page_start"), ["doc_id", "passage_no"])
    first = both.groupBy("item", "doc_id", "exact").agg(F.min(F.struct((~held).alias("other"), "seq", "para", "page_start")).alias("p"))
    return first.select("item", "doc_id", F.col("exact").alias("quote"), F.col("p.para").alias("para"), F.col("p.page_start").alias("page"))


def near_quotes(asked: DataFrame, paras: DataFrame, most_chars: int = 2_000_000) -> DataFrame:
    """(item, doc_id, seq, exact, para, page_start): every paragraph (doc_id, seq, text, para, page_start) that says a quote (item, doc_id, quote), in
    the paragraph's own words. A quote with a null doc_id is looked for in all documents, another one in its own.

    A block of quotes is an index of their character runs; each paragraph is read once against it, and only where enough of a quote's runs
    stand close enough is the quote aligned. No shuffle, and nothing that says a quote is left out."""
    quotes = asked.select("item", F.col("doc_id").cast("string").alias("doc"), normal_form(F.col("quote")).alias("quote")).where("quote <> ''")
    total = quotes.agg(F.sum(F.length("quote"))).first()[0] or 0
    kinds = {c: f.schema[c].dataType.simpleString() for f, names in ((asked, ["item"]), (paras, ["doc_id", "seq", "para", "page_start"])) for c in names}
    schema = ", ".join(f"{c} {kinds[c] if c in kinds else 'string'}" for c in ("item", "doc_id", "seq", "exact", "para", "page_start"))
    spark, parts = asked.sparkSession, []
    for block in blocks(quotes, ["item", "doc", "quote"], total, most_chars):
        held = spark.sparkContext.broadcast(block.toArrow().combine_chunks())  # one block of bounded size

        def read(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items, doc, quote = held.value["item"].combine_chunks(), held.value["doc"].to_pylist(), held.value["quote"].to_pylist()
            index = QuoteGrams(quote)
            for batch in batches:
                row, which, exact = [], [], []
                for at in range(0, batch.num_rows, LINES):
                    own, texts = (batch.column(c).slice(at, LINES).to_pylist() for c in (4, 5))
                    for i, text in enumerate(texts):
                        for number in index.candidates(text) if text else []:
                            if doc[number] is None or doc[number] == own[i]:
                                said = near_quote(quote[number], text)
                                if said is not None:
                                    row.append(at + i), which.append(number), exact.append(said)
                at = pa.array(row, pa.int64())
                yield pa.record_batch([items.take(pa.array(which, pa.int64())), *(batch.column(c).take(at) for c in (0, 1)), pa.array(exact, pa.string()), *(batch.column(c).take(at) for c in (2, 3))], names=["item", "doc_id", "seq", "exact", "para", "page_start"])

        texts = spread(paras.select("doc_id", "seq", "para", "page_start", F.col("doc_id").cast("string").alias("own"), "text"))
        texts = texts.select("doc_id", "seq", "para", "page_start", "own", normal_form(F.col("text")).alias("norm"))
        parts.append(texts.mapInArrow(read, schema))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def find_evidence(asked: DataFrame, paras: DataFrame) -> DataFrame:
    """(item, doc_id, quote, para, page) from the first paragraph (doc_id, seq, text, para, page_start) of its document that says each quote
    (item, doc_id, quote); a quote that none says has nulls."""
    first = near_quotes(asked.where("doc_id IS NOT NULL"), paras).groupBy("item").agg(F.min(F.struct("seq", "exact", "para", "page_start")).alias("p"))
    return asked.select("item", "doc_id").join(first, "item", "left").select("item", "doc_id", F.col("p.exact").alias("quote"), F.col("p.para").alias("para"), F.col("p.page_start").alias("page"))


def source_paragraph(quotes: DataFrame, paras: DataFrame) -> DataFrame:
    """(item, seq, text) of the first paragraph of the quote's document that holds its key span."""
    both = quotes.withColumn("span", X.key_span(normal_form(F.col("quote")))).join(paras.select("doc_id", "seq", "text"), "doc_id")
    first = both.where(F.contains(normal_form(F.col("text")), F.col("span"))).groupBy("item").agg(F.min(F.struct("seq", "text")).alias("p"))
    return first.select("item", "p.seq", "p.text")


def read_json(reply: Column, schema: str) -> Column:
    """The outermost braces by ``schema``; null if they are no JSON object."""
    body = F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.when(F.from_json(body, "map<string,string>").isNotNull(), F.from_json(body, schema))


def numbered(rows: DataFrame, prefix: str, taken: int, order: list[str]) -> DataFrame:
    """``rows`` with ids that go on after the ``taken`` ones of the prefix: s001, s002, ... Rows are those of one run, hence few."""
    turn = F.row_number().over(Window.orderBy(*order)) + taken
    return rows.withColumn("id", F.concat(F.lit(prefix), F.format_string("%03d", turn)))


def record(question: Column, answer: Column, kind: str, qtype: Column, evidence: Column, origin: str = "generated", note: Column | None = None) -> list[Column]:
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return [text(question).alias("question"), text(answer).alias("answer"), F.lit(kind).alias("kind"), F.coalesce(qtype, F.lit("")).alias("qtype"), evidence.cast(EVIDENCE).alias("evidence"), F.lit(origin).alias("origin"), F.lit("pending").alias("status"), (note if note is not None else F.lit("")).alias("note")]


def generate_single(passages: DataFrame, paras: DataFrame, ask: Callable[[DataFrame], DataFrame], done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, progress) from picked passages (doc_id, passage_no, pick, title, section, text): one question each.

    ``done`` (key) are the passages that earlier runs finished; progress has a key and a status for each passage of this one. Only
    calls that ended well are finished, whether or not a usable question came of them; a quote that the passage does not say gives none."""
    todo = passages.withColumn("key", F.concat_ws(":", F.lit("single"), F.col("doc_id").cast("string"), F.col("pick").cast("string")))
    todo = todo.join(done.select("key"), "key", "left_anti") if done is not None else todo
    asked = ask(todo.withColumn("prompt", F.concat(F.lit(SINGLE), F.concat_ws("\n", "title", "section", "text"))))
    got = asked.withColumn("r", read_json(F.col("reply"), "question string, answer string, question_type string, evidence_quote string, skip string"))
    usable = got.where("status = 'ok' AND r IS NOT NULL AND coalesce(r.skip, 'false') = 'false'")
    quotes = usable.select(F.col("key").alias("item"), "doc_id", "passage_no", "text", F.col("r.evidence_quote").alias("quote"))
    proof = evidence_for(quotes, paras).withColumnRenamed("item", "key").drop("doc_id")
    made = usable.select("key", "doc_id", "r").join(proof, "key")
    one = F.array(F.struct(F.col("doc_id").cast("string").alias("doc_id"), "quote", "para", F.col("page").cast("int").alias("page")))
    return made.select("key", *record(F.col("r.question"), F.col("r.answer"), "single", F.col("r.question_type"), one)), asked.select("key", "status")


def draw_pairs(passages: DataFrame, n: int, seed: int = 7, across: float = 0.6, of_bucket: int = 1_000) -> DataFrame:
    """``n`` pairs of different passages of one topic, by hash: (key, a, b), each a passage with its doc_id. The share ``across`` of the draws
    takes the second passage from any document of the topic, the others from the first one's.

    Every passage is drawn as the first of a pair by its hash; its partner is its successor in the drawn order of the topic, or of
    the document. Topics and documents of more than ``of_bucket`` passages are cut into buckets by hash, in which the partners are found: no window holds
    more than a bucket, and no pairs are listed."""
    order = drawn(seed, F.col("doc_id"), F.col("passage_no"))
    whole = F.struct("doc_id", "passage_no", "title", "section", "text")
    ranked = passages.withColumn("order", order).withColumn("whole", whole)
    for name, keys in (("far", ["topic"]), ("near", ["topic", "doc_id"])):
        counts = ranked.groupBy(*keys).agg(F.ceil(F.count("*") / of_bucket).alias("cut"))
        ranked = ranked.join(counts, keys).withColumn(name, F.pmod(F.xxhash64("order"), F.col("cut"))).drop("cut")
    near, far = Window.partitionBy("topic", "doc_id", "near").orderBy("order"), Window.partitionBy("topic", "far").orderBy("order")
    wide = F.pmod(F.xxhash64("order"), F.lit(1000)) < round(across * 1000)
    pairs = ranked.withColumn("b", F.when(wide, F.lead("whole").over(far)).otherwise(F.lead("whole").over(near))).where("b IS NOT NULL AND b.text <> text")
    bucket_turn = F.row_number().over(Window.partitionBy("topic", "far").orderBy("order"))
    few = pairs.withColumn("turn", bucket_turn).where(F.col("turn") <= n)  # n of each bucket at most, then n of each topic, then n
    few = few.withColumn("topic_turn", F.row_number().over(Window.partitionBy("topic").orderBy("order"))).where(F.col("topic_turn") <= n)
    drawn_ones = few.orderBy("topic_turn", "order").limit(n)
    turn = F.row_number().over(Window.orderBy("topic_turn", "order"))  # n rows
    return drawn_ones.withColumn("turn", turn).select(F.concat(F.lit("multi:"), F.col("turn")).alias("key"), F.col("whole").alias("a"), "b")


def generate_multi(pairs: DataFrame, paras: DataFrame, ask: Callable[[DataFrame], DataFrame], done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, progress) from ``draw_pairs``; both quotes must stand in their passages."""
    todo = pairs.join(done.select("key"), "key", "left_anti") if done is not None else pairs
    shown = lambda c: F.concat_ws("\n", f"{c}.title", f"{c}.section", f"{c}.text")
    asked = ask(todo.withColumn("prompt", F.concat(F.lit(MULTI), shown("a"), F.lit("\n\n"), shown("b"))))
    got = asked.withColumn("r", read_json(F.col("reply"), "question string, answer string, evidence_a string, evidence_b string, skip string"))
    usable = got.where("status = 'ok' AND r IS NOT NULL AND coalesce(r.skip, 'false') = 'false'")
    sides = [usable.select(F.struct("key", F.lit(c).alias("side")).alias("item"), F.col(f"{c}.doc_id").alias("doc_id"), F.col(f"{c}.passage_no").alias("passage_no"), F.col(f"{c}.text").alias("text"), F.col(f"r.evidence_{c}").alias("quote")) for c in ("a", "b")]
    proof = evidence_for(sides[0].unionByName(sides[1]), paras)
    one = F.struct(F.col("doc_id").cast("string").alias("doc_id"), "quote", "para", F.col("page").cast("int").alias("page"))
    both = proof.groupBy(F.col("item.key").alias("key")).agg(F.array_sort(F.collect_list(F.struct(F.col("item.side").alias("side"), one.alias("e")))).alias("es")).where("size(es) = 2")
    made = usable.select("key", "r").join(both, "key")
    return made.select("key", *record(F.col("r.question"), F.col("r.answer"), "multi", F.lit("multi_hop"), F.transform("es", lambda x: x["e"]))), asked.select("key", "status")


def generate_unanswerable(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Records of questions (key, question, reason) that the corpus should not answer; those that it did answer (query = key, found, answer) are flagged."""
    both = questions.join(answers.select(F.col("query").alias("key"), "found", "answer"), "key", "left")
    note = F.concat(F.lit("reason: "), F.col("reason"), F.when(F.col("found"), F.concat(F.lit(" | CHECK: it was answered: "), F.substring("answer", 1, 300))).otherwise(""))
    return both.select("key", *record(F.col("question"), F.lit(""), "unanswerable", F.substring_index("reason", ":", 1), F.array().cast(EVIDENCE), "handwritten", note))


def generate_handwritten(items: DataFrame, paras: DataFrame) -> DataFrame:
    """Records of written items (key, doc_id, question, answer, qtype, quote) whose quote stands in a paragraph of their document."""
    proof = find_evidence(items.select(F.col("key").alias("item"), "doc_id", "quote"), paras).where("quote IS NOT NULL").select(F.col("item").alias("key"), "quote", "para", "page")
    one = F.array(F.struct(F.col("doc_id").cast("string").alias("doc_id"), "quote", "para", F.col("page").cast("int").alias("page")))
    return items.drop("quote").join(proof, "key").select("key", *record(F.col("question"), F.col("answer"), "single", F.col("qtype"), one, "handwritten"))


def give_up(progress: DataFrame, order: list[str], most: int = 3) -> bool:
    """Whether ``most`` calls in a row failed: the provider refuses, and the run should stop until later."""
    turn = Window.orderBy(*order)  # one run's calls
    runs = progress.withColumn("run", F.sum(F.when(F.col("status") == "ok", 1).otherwise(0)).over(turn)).where("status <> 'ok'")
    return not runs.groupBy("run").count().where(F.col("count") >= most).isEmpty()


def paraphrased(records: DataFrame, done: DataFrame | None, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The records in everyday words: same id, evidence and answer. Unanswerable ones are copied, those in ``done`` kept as they are, and those
    whose call failed or gave nothing are left for the next run."""
    todo = records.join(done.select("id"), "id", "left_anti") if done is not None else records
    plain = todo.where("kind = 'unanswerable'")
    asked = ask(todo.where("kind <> 'unanswerable'").withColumn("prompt", F.concat(F.lit(PARAPHRASE), F.col("question"))))
    said = F.trim(F.coalesce(read_json(F.col("reply"), "question string")["question"], F.lit("")))
    new = asked.withColumn("said", said).where("status = 'ok' AND said <> ''").withColumn("note", F.concat(F.lit("paraphrase of: "), F.col("question"))).withColumn("question", F.col("said"))
    out = plain.unionByName(new.select(*records.columns))
    return out if done is None else done.select(*records.columns).unionByName(out)


def review_progress(records: DataFrame) -> DataFrame:
    """(kind, n, reviewed, kept, pending) of a set under review."""
    one = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("long")
    return records.groupBy("kind").agg(F.count("*").alias("n"), one(F.col("status") != "pending").alias("reviewed"), one(F.col("status").isin("approved", "edited")).alias("kept"), one(F.col("status") == "pending").alias("pending"))


def to_review(records: DataFrame, kinds: list[str], only_pending: bool = True) -> DataFrame:
    shown = records.where(F.col("kind").isin(kinds))
    return shown.where("status = 'pending'") if only_pending else shown
