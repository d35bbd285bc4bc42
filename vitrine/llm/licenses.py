"""License phrases and an exact set-similarity join of text blocks with license templates.

A block is a line; with ``wrapped`` also each stretch of words across lines that is not longer than the
template allows (its words divided by ``at``), found in overlapping windows. With ``telling`` a block must hold all
of a template's telling tokens, those that alone tell it from another license. Template tokens are ordered by their frequency in the whole corpus, rarest first.
A block meets a template if it holds at least ``at`` of the template's distinct tokens. For that it must
hold one of the template's first ``|T| - needed + 1`` tokens (prefix filter), at least ``needed``
template tokens at all (length filter), and from the first shared token on enough tokens must be
left in both (positional filter). What passes is verified by intersection, so the join is exact.

Everything is SQL functions and joins; the templates are a fixed small table. A null text is empty:
no words, no labels, score 0. Null and repeated ids and repeated rows keep their own rows; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import text_key
from vitrine.session import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: License notices; a label may have several.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by", "licensed under cc by 4.0"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("cc0", "dedicated to the public domain under cc0 1.0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the mozilla public license v 2.0"),
    ("reserved", "all rights reserved"),
)
#: Tokens without which a notice is of another license.
TELLING = frozenset("mit apache gnu nc sa cc0 mozilla".split())


def words(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _places(w: Column, phrase: list[str]) -> Column:
    """Word positions where the phrase's words stand one after the other."""
    last = F.size(w) - len(phrase)

    def here(i):
        out = F.get(w, i) == phrase[0]
        for k, p in enumerate(phrase[1:], 1):
            out = out & (F.get(w, i + k) == p)
        return out

    none = F.expr("cast(array() as array<int>)")
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(none)


def base_phrases(docs: DataFrame, phrases=PHRASES) -> DataFrame:
    """``(doc_id, tk, n_words, n_base, first_word, last_word, found)`` per row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text_key(text).alias("tk"), ascii_lower(text).alias("_low"))
    may = "|".join(GAP.join(p.split()) for p in phrases)
    w = words(F.col("_low"))
    rows = rows.select(
        "doc_id",
        "tk",
        F.when(F.col("_low").rlike(may), F.struct(w.alias("w"), F.size(w).cast("long").alias("n")))
        .otherwise(F.struct(F.expr("cast(array() as array<string>)").alias("w"), F.regexp_count("_low", F.lit(WORD)).cast("long").alias("n")))
        .alias("_x"),
    ).select("doc_id", "tk", F.col("_x.n").alias("n_words"), F.col("_x.w").alias("_w"))

    def labelled(phrase: str) -> Column:
        label = F.lit(phrases[phrase]).alias("label")
        return F.transform(_places(F.col("_w"), phrase.split()), lambda i: F.struct(i.alias("i"), label))

    rows = rows.withColumn("_hits", F.concat(*map(labelled, phrases))).withColumn("_at", F.transform("_hits", lambda x: x["i"].cast("long")))
    return rows.select(
        "doc_id",
        "tk",
        "n_words",
        F.size("_hits").cast("long").alias("n_base"),
        F.array_min("_at").alias("first_word"),
        F.array_max("_at").alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("_hits", lambda x: x["label"]))).alias("found"),
    )


def _tokens(text: str) -> list[str]:
    return sorted(set(text.replace(".", " ").split()))


def template_blocks(
    docs: DataFrame, at: float = 0.8, templates=TEMPLATES, telling: frozenset = frozenset(), wrapped: bool = False
) -> DataFrame:
    """``(doc_id, tk, line, label, containment)`` of every block that meets a template; ``line`` is null across lines."""
    spark = docs.sparkSession
    sets = [(i, label, _tokens(text)) for i, (label, text) in enumerate(templates)]
    vocabulary = sorted({t for _, _, ts in sets for t in ts})
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text_key(text).alias("tk"), ascii_lower(text).alias("_low"))

    # Global order: how often each template token stands in the corpus; one row per token.
    used = F.filter(words(F.col("_low")), lambda t: t.isin(vocabulary))
    counts = rows.select(F.explode(used).alias("t")).groupBy("t").count().collect()
    freq = {r["t"]: r["count"] for r in counts}
    order = sorted(vocabulary, key=lambda t: (freq.get(t, 0), t))
    rank = {t: i for i, t in enumerate(order)}

    prefixes, heads = [], set()
    for i, label, ts in sets:
        ts = sorted(ts, key=rank.get)
        needed = math.ceil(round(at * len(ts), 9))
        for pos, t in enumerate(ts[: len(ts) - needed + 1]):
            span = int(round(len(templates[i][1].replace(".", " ").split()) / at, 9))
            prefixes.append((t, pos, i, label, ts, needed, [t for t in ts if t in telling], span))
            heads.add(t)
    names = ("t", "i", "template", "label", "ts", "needed", "tell", "span")
    cell = lambda x: F.array(*map(F.lit, x)).cast("array<string>") if isinstance(x, list) else F.lit(x)
    structs = [F.struct(*[cell(x).alias(n) for n, x in zip(names, row)]) for row in prefixes]
    prefix = spark.range(1).select(F.inline(F.array(*structs)))

    # Lines without any prefix token cannot meet a template.
    edge = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
    head = f"(?:^|{edge})(?:{'|'.join(sorted(heads))})(?:{edge}|$)"
    noted = rows.where(F.col("_low").rlike(head))
    lines = noted.select(
        "doc_id", "tk", F.posexplode(F.split("_low", "\n")).alias("line", "_line")
    )
    lines = lines.where(F.col("_line").rlike(head)).select(
        "doc_id", "tk", "line", F.array_distinct(F.filter(words(F.col("_line")), lambda t: t.isin(vocabulary))).alias("_b")
    )
    lines = lines.withColumn("_w", F.lit(None).cast("array<string>"))
    if wrapped:
        # Windows of two spans, one span apart: every stretch of up to a span lies in one of them.
        step = max((x[-1] for x in prefixes), default=1)
        cut = noted.where(F.col("_low").contains("\n")).select("doc_id", "tk", F.explode(F.array(words(F.col("_low")))).alias("_all"))
        cut = cut.select(
            "doc_id",
            "tk",
            F.explode(
                F.transform(
                    F.sequence(F.lit(0), F.floor(F.size("_all") / step).cast("int")),
                    lambda i: F.slice("_all", i * step + 1, F.lit(2 * step)),
                )
            ).alias("_w"),
        ).where(F.arrays_overlap("_w", F.array(*map(F.lit, sorted(heads)))))
        known = F.array_distinct(F.filter("_w", lambda t: t.isin(vocabulary)))
        lines = lines.unionByName(cut.select("doc_id", "tk", F.lit(None).cast("int").alias("line"), known.alias("_b"), "_w"))
    ranks = F.create_map(*[F.lit(x) for t in order for x in (t, rank[t])])
    ordered = F.array_sort(F.transform("_b", lambda t: F.struct(F.element_at(ranks, t).alias("r"), t.alias("t"))))
    tokens = lines.select("doc_id", "tk", "line", "_b", "_w", F.posexplode(ordered).alias("j", "_t"))
    left_t, left_b = F.size("ts") - F.col("i"), F.size("_b") - F.col("j")
    pairs = (
        tokens.withColumn("t", F.col("_t.t"))
        .join(F.broadcast(prefix), "t")  # as long as the fixed template table
        .where((F.size("_b") >= F.col("needed")) & (F.least(left_t, left_b) >= F.col("needed")))
    )

    def holds(block) -> Column:
        return (F.size(F.array_intersect(block, "ts")) >= F.col("needed")) & (F.size(F.array_except("tell", block)) == 0)

    # Across lines the words must stand together; containment is that of the best stretch.
    stretches = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w"), F.lit(1))), lambda i: F.slice("_w", i, F.col("span")))
    best = F.array_max(F.transform(F.filter(stretches, holds), lambda x: F.size(F.array_intersect(x, "ts"))))
    shared = F.when(F.col("_w").isNull(), F.size(F.array_intersect("_b", "ts"))).otherwise(best)
    return (
        pairs.where(holds(F.col("_b")))
        .withColumn("shared", shared)
        .where("shared is not null")
        .select("doc_id", "tk", "line", "template", "label", (F.col("shared") / F.size("ts")).alias("containment"))
        .groupBy("doc_id", "tk", "line", "label")
        .agg(F.max("containment").alias("containment"))
    )


def scan(
    docs: DataFrame, at: float = 0.8, templates=TEMPLATES, phrases=PHRASES, telling: frozenset = frozenset(), wrapped: bool = False
) -> DataFrame:
    """Per row: base phrase counts, base labels, all labels and the best containment.

    ``score`` is the largest containment of a matched template, 1 where a base phrase stands.
    """
    base = base_phrases(docs, phrases)
    met = (
        template_blocks(docs, at, templates, telling, wrapped)
        .groupBy("doc_id", "tk")
        .agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best"))
        .withColumnsRenamed({"doc_id": "_id", "tk": "_tk"})
    )
    met = materialize(met, "license-blocks")
    none = F.expr("cast(array() as array<string>)")
    more = F.coalesce("_more", none)
    return base.join(met, (F.col("tk") == F.col("_tk")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("found", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("found", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )
