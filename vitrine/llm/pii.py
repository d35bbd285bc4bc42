"""Personal data by patterns, and information-theoretic sanitisation of the terms around it.

Base spans are e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers. The
protected entities are their values. For each word of a document with an entity the corpus tells how much
of the entity's information it discloses: pointwise mutual information over whole documents, divided by the
entity's own information content. Terms that reach ``generalise_at`` are replaced by their
kind of word, terms that reach ``remove_at`` are removed, wherever they stand in the documents of the entity.
A pair counts only if it stands in at least ``min_contexts`` different contexts, so copies of one text are
no evidence.

Everything is SQL functions and joins. A null text is empty and has no spans. Rows are matched by
id and text, so null ids, repeated ids and repeated rows each get their own right result; other columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import matches, text_key
from vitrine.session import materialize

# The patterns below find the same matches as the plain forms in the comments, without their
# backtracking; a card run is looked at only if it has 13 digits.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[0-9][\x20-]?){12}[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
WORD = r"[\p{L}\p{N}_]{3,}"
SPAN = "struct<kind:string,s:bigint,e:bigint>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(bare(p)) <= 3) & (bare(p).try_cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def with_spans(docs: DataFrame, text: str, into: str = "_spans") -> DataFrame:
    """Add array<struct<kind, s, e>> of the base spans, by kind as listed, then start."""

    def spans_of(kind: str) -> Column:
        valid = F.filter(matches(F.col(text), PATTERNS[kind]), lambda x: _valid(kind, x["m"]))
        return F.transform(valid, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))

    return docs.withColumn(into, F.concat(*map(spans_of, KINDS)))


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _held(held: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, tk, c, ctx, l, r)``: each entity, its window and the print of what stands there; and
    ``(doc_id, tk, t, s, e)``: each word of the documents that hold an entity, outside the base spans."""
    # A fixed number of partitions: the texts are few and long, so that merging small ones leaves a few slow tasks.
    n = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = held.repartition(n, "doc_id", "tk").dropDuplicates(["doc_id", "tk"])
    near = held.select("doc_id", "tk", "_text", F.explode("_spans").alias("x"))
    start, end = F.col("x.s").cast("int"), F.col("x.e").cast("int")
    left = F.greatest(start - window, F.lit(0))
    value = F.substring("_text", start + 1, end - start)
    around = F.xxhash64(F.substring("_text", left + 1, start - left), F.substring("_text", end + 1, F.lit(window)))
    entities = near.select(
        "doc_id",
        "tk",
        F.concat_ws(":", "x.kind", F.when(F.col("x.kind").isin("card", "phone"), _digits(value)).otherwise(F.lower(value))).alias("c"),
        around.alias("ctx"),
        left.alias("l"),
        (end + window).alias("r"),
    )
    free = F.filter(
        matches(F.col("_text"), WORD),
        lambda w: ~F.exists("_spans", lambda x: (x["s"] < w["e"]) & (w["s"] < x["e"])),
    )
    words = held.select("doc_id", "tk", F.explode(free).alias("w"))
    return entities, words.select("doc_id", "tk", F.lower("w.m").alias("t"), "w.s", "w.e")


def _in_one(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one document side by side; its id may be null."""
    right = right.withColumnsRenamed({"doc_id": "_id", "tk": "_tk"})
    same = (F.col("tk") == F.col("_tk")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return left.join(right, same).drop("_id", "_tk")


def disclosing_terms(
    docs: DataFrame, entities: DataFrame, words: DataFrame, generalise_at: float, remove_at: float, min_contexts: int
) -> tuple[DataFrame, DataFrame]:
    """``(c, t, action)`` of the terms that disclose an entity beyond the threshold, and the words that may.

    The share is PMI(c, t) / IC(c): 1 if the term never stands without the entity. Documents are counted
    whole, wherever the term stands in them.
    """
    alone = entities.select("c", "doc_id", "tk").distinct().groupBy("c").agg(F.count("*").alias("n_c"))
    alone = materialize(alone, "pii-entities")
    # Documents that hold each word, over the whole corpus: merged per task before the shuffle.
    distinct = F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(WORD), F.lit(0)))
    in_docs = docs.select(F.explode(distinct).alias("t")).groupBy("t").agg(F.count("*").alias("n_t"))
    total = docs.count()
    # Exact bound: the share is largest where all documents of the entity hold the term, so a term
    # in more documents than this discloses none. Common words are left out before they meet entities.
    most = alone.agg(F.max("n_c")).first()[0] or 0
    bound = float(total) ** (1 - generalise_at) * float(most) ** generalise_at * (1 + 1e-9)
    rare = materialize(in_docs.where(F.col("n_t") <= bound), "pii-terms")
    words = materialize(words.join(rare, "t"), "pii-words")
    pairs = _in_one(
        words.select("doc_id", "tk", "t", "n_t").distinct(),
        entities.select("doc_id", "tk", "c").distinct(),
    )
    both = pairs.groupBy("c", "t").agg(F.count("*").alias("n_ct"), F.max("n_t").alias("n_t"))
    ratio = F.col("n_ct") * float(total) / (F.col("n_c") * F.greatest("n_t", "n_ct"))
    content = F.log2(F.lit(float(max(total, 1))) / F.col("n_c"))
    wanted = (
        both.join(alone, "c")
        .withColumn("share", F.when(content > 0, F.log2(ratio) / content).otherwise(0.0))
        .where(F.col("share") >= generalise_at)
        .select("c", "t", F.when(F.col("share") >= remove_at, "remove").otherwise("general").alias("action"))
    )
    wanted = materialize(wanted, "pii-pairs")
    # Within the window the context is what stands there, beyond it the text.
    inside = (F.col("s") >= F.col("l")) & (F.col("e") <= F.col("r"))
    here = _in_one(words.join(wanted.select("t").distinct(), "t", "left_semi"), entities)
    here = here.join(wanted, ["c", "t"]).select("c", "t", F.when(inside, F.col("ctx")).otherwise(F.col("tk")).alias("ctx"))
    contexts = here.distinct().groupBy("c", "t").agg(F.count("*").alias("contexts"))
    enough = contexts.where(F.col("contexts") >= min_contexts).select("c", "t")
    return materialize(wanted.join(enough, ["c", "t"], "left_semi"), "pii-disclosing"), words


def find(
    docs: DataFrame,
    window: int = 64,
    generalise_at: float = 0.6,
    remove_at: float = 0.9,
    min_contexts: int = 2,
) -> DataFrame:
    """``(doc_id, tk, base, added)`` per row: base spans, and term spans whose kind is the action.

    ``window``, in code points to either side of an entity, bounds the contexts that are told apart, not
    the terms; ``tk`` is ``text_key`` of the text.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    texts = texts.withColumn("tk", text_key("_text"))
    # The spans are found once; only the texts that hold some are written beside them.
    held = F.when(F.size("_spans") > 0, F.col("_text")).alias("_text")
    spotted = materialize(with_spans(texts, "_text").select("doc_id", "tk", "_spans", held), "pii-base")
    base = spotted.select("doc_id", "tk", F.col("_spans").alias("base"))
    entities, words = _held(spotted.where("_text is not null"), window)
    entities = materialize(entities, "pii-held")
    terms, words = disclosing_terms(texts, entities, words, generalise_at, remove_at, min_contexts)
    # Every occurrence of a term in a document that holds its entity.
    marked = words.join(terms.withColumnRenamed("c", "_c"), "t")
    marked = _in_one(marked, entities.select("doc_id", "tk", "c").distinct()).where("c = _c")
    added = (
        marked.groupBy("doc_id", "tk", "s", "e")
        .agg(F.max("action").alias("action"))
        .groupBy("doc_id", "tk")
        .agg(F.array_sort(F.collect_list(F.struct("s", "e", "action"))).alias("added"))
        .select(
            F.col("doc_id").alias("_id"),
            F.col("tk").alias("_tk"),
            F.transform("added", lambda x: F.struct(x["action"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))).alias("added"),
        )
    )
    return base.join(added, (F.col("tk") == F.col("_tk")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", "tk", "base", F.coalesce("added", F.expr(f"cast(array() as array<{SPAN}>)")).alias("added")
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced; where spans overlap the earlier one takes the rest in.

    Base spans become ``[kind]``, general terms ``[word]`` or ``[number]``, removed terms nothing.
    """
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def put(acc, x):
        old = F.substring(text, (x["s"] + 1).cast("int"), (x["e"] - x["s"]).cast("int"))
        new = (
            F.when(x["kind"] == "remove", "")
            .when((x["kind"] == "general") & old.rlike("[0-9]"), "[number]")
            .when(x["kind"] == "general", "[word]")
            .otherwise(F.concat(F.lit("["), x["kind"], F.lit("]")))
        )
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int"))
        return F.when(x["s"] < acc["at"], F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(x["e"].alias("at"), F.concat(acc["out"], F.array(gap, new)).alias("out"))
        )

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    return F.aggregate(
        ordered,
        zero,
        put,
        lambda acc: F.concat(
            F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))
        ),
    )


def sanitise(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with base spans and disclosing terms replaced in ``text``; all columns stay.

    A null text stays null. ``n_chars``, where it is there, becomes the new length.
    """
    found = find(docs, **params).select(
        F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), F.concat("base", "added").alias("_spans")
    )
    found = found.where(F.size("_spans") > 0).dropDuplicates(["_id", "_tk"])
    # Columns are named through their frames: ``docs`` may hold any names.
    spans, text = found["_spans"], docs["text"]
    same = (text_key(text) == found["_tk"]) & docs["doc_id"].eqNullSafe(found["_id"])
    changed = {"text": F.when(spans.isNotNull(), redacted(text, spans)).otherwise(text)}
    if "n_chars" in docs.columns:
        size = F.length(changed["text"]).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(spans.isNotNull(), size).otherwise(docs["n_chars"])
    return docs.join(found, same, "left").select(*[changed.get(c, docs[c]).alias(c) for c in docs.columns])
