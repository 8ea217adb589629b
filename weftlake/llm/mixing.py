"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic): a token for each blank,
and one for every eight bytes at least, where texts have few blanks.  The cell
weights are raked to the target marginals of the three dimensions in turn
until all marginals are met within ``tolerance``; documents are then drawn
independently with the chances that the raked weights imply, scaled so that the
tokens expected are a given share of the input, and never above 1 (cells that
would be are taken whole and the rest is scaled up).  The cells are raked in
the driver while there are at most LOCAL_CELLS of them and as a table
otherwise, by the same steps.

Default targets soften each dimension: a value with share p gets a share in
proportion to ``p ** alpha``.  Targets for values that don't occur are ignored,
a null target is that of the null value, and values without a target get 0; a
dimension whose targets name no value that occurs is an error.  Targets that
contradict each other can't be met: raking ends with a round that comes no
nearer (by a thousandth of what was left), or after ``max_rounds``, with the
last dimension met exactly, and marginals() tells how far the others are.

The topic is a column of one's own (``topic_col``), or by default a coarse kind
of text by marks in it (topic()).

Defined cases: nulls in a dimension are a value of their own; a null or empty text
weighs one token; repeated rows share one draw, as the draw
depends on the id alone, and so do all rows with a null id; a draw that equals
the chance isn't taken; an empty table stays empty.  All columns pass through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, isolate, restore, table, uniform, uniform_sql

ALPHA = 0.7
KEEP = 0.6
TOLERANCE = 1e-12
MAX_ROUNDS = 500
DIMS = ("source", "lang", "topic")
NULL = "<null>"
#: More cells than this are raked as a distributed table and joined by shuffling.
LOCAL_CELLS = 100_000


def topic(text: Column) -> Column:
    """A coarse kind of text, by its first mark in this order."""
    return (
        F.when(text.contains("icense"), "licence")
        .when(text.contains(' = "'), "code")
        .when(text.contains("@"), "contact")
        .when(text.contains("###") | text.contains("!!"), "markup")
        .otherwise("prose")
    )


TOPIC_SQL = """CASE WHEN contains(text, 'icense') THEN 'licence' WHEN contains(text, ' = "') THEN 'code'
 WHEN contains(text, '@') THEN 'contact' WHEN contains(text, '###') OR contains(text, '!!') THEN 'markup' ELSE 'prose' END"""


def soften(shares: np.ndarray, alpha: float) -> np.ndarray:
    p = (shares / shares.sum()) ** alpha
    return p / p.sum()


def _named(given: dict) -> dict[str, float]:
    return {NULL if k is None else str(k): float(v) for k, v in given.items() if v}


def _targets(keys, mass, given: dict | None, alpha: float):
    values, inverse = np.unique(np.array(keys, object), return_inverse=True)
    if given is None:
        share = soften(np.bincount(inverse, mass), alpha)
    else:
        named = _named(given)
        share = np.array([named.get(v, 0.0) for v in values])
        if share.sum() <= 0:
            raise ValueError("no target for any value that occurs")
        share = share / share.sum()
    return inverse, share


def rake(cells: list[tuple], targets: dict[str, dict] | None = None, alpha: float = ALPHA, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> np.ndarray:
    """The mass of each cell (source, lang, topic, mass) after raking; it sums to the mass given."""
    mass = np.array([c[3] for c in cells], float)
    total, w = mass.sum(), mass.copy()
    dims = [_targets([c[k] for c in cells], mass, (targets or {}).get(d), alpha) for k, d in enumerate(DIMS)]
    last = np.inf
    for _ in range(max_rounds):
        for inverse, share in dims:
            have = np.bincount(inverse, w, len(share))
            w = w * np.divide(share * total, have, out=np.zeros_like(have), where=have > 0)[inverse]
        off = max(np.abs(np.bincount(i, w, len(share)) / total - share).max() for i, share in dims)
        if off < tolerance or off > 0.999 * last:
            break
        last = off
    return w


def marginals(cells: list[tuple], raked: np.ndarray, targets: dict[str, dict] | None = None, alpha: float = ALPHA) -> dict[str, float]:
    """By dimension: how far the share of a value is from its target at most."""
    mass = np.array([c[3] for c in cells], float)
    out = {}
    for k, d in enumerate(DIMS):
        inverse, share = _targets([c[k] for c in cells], mass, (targets or {}).get(d), alpha)
        out[d] = float(np.abs(np.bincount(inverse, raked, len(share)) / mass.sum() - share).max())
    return out


def _scale(sums, keep: float) -> float:
    """c such that the mass of min(1, c * raked / mass) is ``keep`` of all, or infinity if all there is to take is no more.

    ``sums(c)``: (mass of all, mass of cells that c takes whole, raked mass of
    the others).  Each step takes the cells whole that the last one would; they
    only become more, so it ends.
    """
    c = 0.0
    while True:
        total, whole, rest = sums(c)
        if rest <= 1e-12 * total or keep * total <= whole:
            return np.inf if rest <= 1e-12 * total else c
        new = (keep * total - whole) / rest
        if new <= c * (1 + 1e-12):
            return c
        c = new


def chances(mass: np.ndarray, raked: np.ndarray, keep: float = KEEP) -> np.ndarray:
    """min(1, c * raked / mass) with c such that the mass expected is ``keep`` of all, or all there is to take."""
    w = raked / mass

    def sums(c: float):
        whole = c * w >= 1
        return mass.sum(), mass[whole].sum(), raked[~whole].sum()

    c = _scale(sums, keep)
    return (w > 0).astype(float) if np.isinf(c) else np.minimum(1.0, c * w)


def _rake_table(cells: DataFrame, targets, alpha: float, tolerance: float, max_rounds: int) -> DataFrame:
    """rake() for cells beyond what a driver should hold."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("mass")).first()[0])
    for d in DIMS:
        here = cells.groupBy(d).agg(F.sum("mass").alias("m"))
        if (given := (targets or {}).get(d)) is not None:
            here = here.join(spark.createDataFrame(list(_named(given).items()), f"{d} string, t double"), d, "left").fillna(0.0, ["t"])
        else:
            here = here.withColumn("t", F.pow(F.col("m") / total, F.lit(alpha)))
        here = cut(here)
        held = here.agg(F.sum("t")).first()[0]
        if not held:
            raise ValueError("no target for any value that occurs")
        cells = cells.join(here.select(d, (F.col("t") / held * total).alias(f"goal_{d}")), d)
    cells = cut(cells.withColumn("raked", F.col("mass").cast("double")))
    held = lambda d: cells.groupBy(d).agg(F.sum("raked").alias("have"), F.first(f"goal_{d}").alias("goal"))
    last = np.inf
    for _ in range(max_rounds):
        for d in DIMS:
            factor = held(d).select(d, F.when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(0.0).alias("factor"))
            cells = cells.join(factor, d).withColumn("raked", F.col("raked") * F.col("factor")).drop("factor")
        cells = cut(cells)
        off = max(held(d).agg(F.max(F.abs(F.col("have") - F.col("goal")))).first()[0] for d in DIMS) / total
        if off < tolerance or off > 0.999 * last:
            break
        last = off
    return cells.select(*DIMS, "mass", "raked")


def _chance_table(cells: DataFrame, keep: float) -> DataFrame:
    """chances() for a table of cells, one aggregate for each step."""
    w = F.col("raked") / F.col("mass")

    def sums(c: float):
        whole = F.lit(c) * w >= 1
        row = cells.agg(F.sum("mass"), F.sum(F.when(whole, F.col("mass"))), F.sum(F.when(~whole, F.col("raked")))).first()
        return tuple(float(v or 0) for v in row)

    c = _scale(sums, keep)
    return cells.select(*DIMS, ((w > 0).cast("double") if np.isinf(c) else F.least(F.lit(1.0), F.lit(c) * w)).alias("p"))


def _marked(docs: DataFrame, source_col, lang_col, text_col, topic_of, topic_col):
    inner, (s, lang, t, *own) = isolate(docs, source_col, lang_col, text_col, *([topic_col] if topic_col else []))
    t = t.cast("string")
    kind = F.coalesce(own[0].cast("string"), F.lit(NULL)) if own else topic_of(F.coalesce(t, F.lit("")))
    dims = (F.coalesce(s.cast("string"), F.lit(NULL)), F.coalesce(lang.cast("string"), F.lit(NULL)), kind)
    size = F.octet_length(t)
    mass = F.greatest(F.coalesce(F.greatest(size - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))), (size / 8).cast("int")), F.lit(0)), F.lit(1)).cast("long")
    return inner.select("*", *(c.alias(d) for c, d in zip(dims, DIMS)), mass.alias("mass"))


def with_chance(docs, source_col="source", lang_col="lang", text_col="text", topic_of=topic, topic_col=None, targets=None, alpha=ALPHA, keep=KEEP, tolerance=TOLERANCE, max_rounds=MAX_ROUNDS, local_cells=LOCAL_CELLS):
    marked = _marked(docs, source_col, lang_col, text_col, topic_of, topic_col)
    cells = cut(marked.groupBy(*DIMS).agg(F.sum("mass").alias("mass")))
    n = cells.count()
    if n <= local_cells:
        rows = sorted(tuple(r) for r in cells.collect())
        raked = rake(rows, targets, alpha, tolerance, max_rounds) if rows else np.zeros(0)
        p = chances(np.array([r[3] for r in rows], float), raked, keep) if rows else []
        by_cell = docs.sparkSession.createDataFrame([(*r[:3], float(x)) for r, x in zip(rows, p)], "source string, lang string, topic string, p double")
        by_cell = F.broadcast(by_cell)  # no more than local_cells rows
    elif n:
        by_cell = cut(_chance_table(_rake_table(cells, targets, alpha, tolerance, max_rounds), keep))
    else:
        by_cell = cells.select(*DIMS, F.lit(1.0).alias("p"))
    return marked.join(by_cell, list(DIMS))


def sample(docs: DataFrame, id_col: str = "doc_id", seed: int = 5, **how) -> DataFrame:
    """The documents drawn, all columns as they are."""
    _, (i,) = isolate(docs, id_col)
    drawn = with_chance(docs, **how).where(uniform(i, f"mix{seed}") < F.col("p"))
    return restore(drawn, docs)


def weights(docs: DataFrame, id_col: str = "doc_id", seed: int = 5, **how) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, p) of the documents drawn."""
    _, (i,) = isolate(docs, id_col)
    drawn = with_chance(docs, **how).where(uniform(i, f"mix{seed}") < F.col("p"))
    return drawn.select(i.alias("doc_id"), *DIMS, F.col("mass").alias("n_tokens"), F.round("p", 6).alias("p"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(table(spark, sf_dir, "documents"))


def sql(rounds: int = 40) -> str:
    goals = ",\n".join(f"g_{d} AS (SELECT {d}, pow(sum(mass), {ALPHA}) / sum(pow(sum(mass), {ALPHA})) OVER () AS t FROM cells GROUP BY {d})" for d in DIMS)
    steps, last = [], "r0"
    for k in range(rounds * len(DIMS)):
        d = DIMS[k % len(DIMS)]
        steps.append(f"r{k + 1} AS (SELECT source, lang, topic, mass, total, t_source, t_lang, t_topic, raked * t_{d} * total / sum(raked) OVER (PARTITION BY {d}) AS raked FROM {last})")
        last = f"r{k + 1}"
    nl = ",\n"
    return f"""
WITH marked AS (
  SELECT doc_id, coalesce(source, '{NULL}') AS source, coalesce(lang, '{NULL}') AS lang, greatest(strlen(text) - strlen(replace(text, ' ', '')), strlen(text) // 8, 1) AS mass, {TOPIC_SQL} AS topic
  FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents)),
cells AS (SELECT source, lang, topic, sum(mass)::DOUBLE AS mass FROM marked GROUP BY ALL),
{goals},
r0 AS (SELECT c.*, sum(mass) OVER () AS total, g_source.t AS t_source, g_lang.t AS t_lang, g_topic.t AS t_topic, mass AS raked
  FROM cells c JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic)),
{nl.join(steps)},
ranked AS (SELECT *, raked / mass AS w,
  coalesce(sum(mass) OVER o, 0) AS taken, sum(raked) OVER () - coalesce(sum(raked) OVER o, 0) AS rest
  FROM {last} WINDOW o AS (ORDER BY raked / mass DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
scale AS (SELECT min(taken) AS at, arg_min(({KEEP} * total - taken) / rest, taken) AS c FROM ranked WHERE ({KEEP} * total - taken) / rest * w <= 1),
chance AS (SELECT source, lang, topic, least(1.0, c * w) AS p FROM ranked, scale)
SELECT doc_id, source, lang, topic, mass::BIGINT AS n_tokens, round(p, 6) AS p
FROM marked JOIN chance USING (source, lang, topic) WHERE {uniform_sql("doc_id", "mix5")} < p
"""


SQL = sql()
