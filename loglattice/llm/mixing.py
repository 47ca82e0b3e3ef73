"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Tokens are summed by cell (source, language, topic).  Raking multiplies the cells' weights so that their sums meet the
three target marginals in turn, for ``SWEEPS`` sweeps; a document's probability is its cell's weight per token times
the rate that meets the token budget with probabilities of at most 1, and a document is kept when a hash of its id falls
below its probability.

Texts are read once: what they hold is stored beside the rows.  Sums over all cells are aggregates of one row; a sum by
dimension is a window over the cells of one value, never over documents.  Up to ``FEW_CELLS`` cells are raked in one task,
so that the windows need no exchange; more are dealt anew for each window, in plans of one sweep, since the driver holds
all stages of a plan.  Documents meet their cells by a broadcast of at most ``MOST_CELLS`` rows, beyond it by join_classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm._store import drop, join_classes, stored

WORD = r"[^\x20\x09-\x0D]+"
DIMENSIONS = ("source", "lang", "topic")
EXPONENTS = {"source": 0.5, "lang": 0.7, "topic": 0.7}  # a marginal's target is its token share to this power
BUDGET = 0.5  # expected tokens kept, as a share of all
SWEEPS = 12
RATE_STEPS = 6
FEW_CELLS = 10_000  # raked in one task
MOST_CELLS = 100_000  # broadcast, about 10 MB


def tokens_of(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text, tokens) -> F.Column:
    """The form of a text, which stands in for its topic where the table has no such column."""
    bars = F.length(text) - F.length(F.regexp_replace(text, r"\|", ""))
    lines = F.length(text) - F.length(F.regexp_replace(text, "\n", ""))
    return F.when(tokens == 0, "empty").when(bars * 5 >= tokens, "table").when(lines * 12 >= tokens, "lines").when(tokens < 200, "short").when(tokens < 1000, "article").otherwise("long")


def described(docs: DataFrame, *dropped: str) -> DataFrame:
    """docs without the dropped columns, with _source, _lang, _topic (null: empty string) and _tokens."""
    out = docs.withColumn("_tokens", tokens_of(F.col("text")))
    topic = F.col("topic").cast("string") if "topic" in docs.columns else topic_of(F.col("text"), F.col("_tokens"))
    return out.withColumns({"_source": F.coalesce(F.col("source"), F.lit("")), "_lang": F.coalesce(F.col("lang"), F.lit("")), "_topic": F.coalesce(topic, F.lit(""))}).drop(*dropped)


def raked(cells: DataFrame, exponents: dict[str, float] | None = None, shares: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, sweeps: int = SWEEPS, few: int = FEW_CELLS) -> DataFrame:
    """cells(_source, _lang, _topic, n, ...) with weight per token and probability.

    shares: explicit target shares by dimension and value (values not named get none); else tempered token shares.
    few: the most cells that one task rakes; the results are the same either way.
    """
    exponents = exponents or EXPONENTS
    total, count = cells.agg(F.sum("n"), F.count("*")).first()
    total, alone = float(total or 0), count <= few
    out = cells.withColumns({"n": F.col("n").cast("double"), "_w": F.col("n").cast("double")})
    out = out.repartition(1) if alone else out
    for d in DIMENSIONS:
        sums = cells.groupBy(f"_{d}").agg((F.sum("n").cast("double") / total if total else F.lit(0.0)).alias("share"))
        if shares and d in shares:
            given = F.create_map(*(x for k, v in shares[d].items() for x in (F.lit(k), F.lit(float(v))))) if shares[d] else F.create_map(F.lit(""), F.lit(0.0))
            target = F.coalesce(given[F.col(f"_{d}")], F.lit(0.0))
        else:
            target = F.pow("share", F.lit(exponents[d]))
        whole = float(sums.agg(F.sum(target)).first()[0] or 0)
        share = F.sum("n").over(Window.partitionBy(f"_{d}")) / F.lit(total or 1.0)
        out = out.withColumn("share", share).withColumn(f"_t_{d}", F.lit(total) * target / F.lit(whole or 1.0)).drop("share")
    before = None
    for k in range(sweeps):
        if k % (SWEEPS if alone else 1) == 0 and (k or not alone):  # a plan of bounded depth
            now = stored(out, "sweeps")
            if before is not None:
                drop(before)
            before, out = now, now.repartition(1) if alone else now
        for d in DIMENSIONS:
            held = F.sum("_w").over(Window.partitionBy(f"_{d}"))
            out = out.withColumn("_w", F.when(held > 0, F.col("_w") * F.col(f"_t_{d}") / held).otherwise(0.0))
    out = stored(out.withColumn("weight", F.when(F.col("n") > 0, F.col("_w") / F.col("n")).otherwise(0.0)), "raked")
    if before is not None:
        drop(before)
    rate = float(budget)
    for _ in range(RATE_STEPS):
        full = F.col("weight") * rate >= 1
        sure, open_ = out.agg(F.sum(F.when(full, F.col("n")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_w")))).first()
        rate = (total * budget - sure) / open_ if open_ and open_ > 0 else rate
    return out.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * rate))


def off_target(cells: DataFrame) -> float:
    """The largest relative distance of a raked marginal from its target; 0 once the sweeps have converged."""
    worst = 0.0
    for d in DIMENSIONS:
        sums = cells.groupBy(f"_{d}").agg(F.sum("_w").alias("w"), F.max(f"_t_{d}").alias("t")).where("t > 0")
        worst = max(worst, sums.agg(F.max(F.abs(F.col("w") / F.col("t") - 1))).first()[0] or 0.0)
    return worst


def uniform(doc_id, seed: str = "mix") -> F.Column:
    """A number in [0, 1) from a hash of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mix(docs: DataFrame, *dropped: str, **options) -> DataFrame:
    """Every row of docs, without the dropped columns, with _source, _lang, _topic, _tokens, weight, probability and selected."""
    rows = stored(described(docs, *dropped), "described")
    by = [f"_{d}" for d in DIMENSIONS]
    cells = stored(rows.groupBy(*by).agg(F.sum("_tokens").alias("n"), F.count("*").alias("_rows")), "mixcells")
    rated = raked(cells, **options).select(*by, "_rows", "weight", "probability")
    if cells.count() <= MOST_CELLS:
        joined = rows.join(F.broadcast(rated.drop("_rows")), by)
    else:
        one = F.struct(*by)
        joined = join_classes(rows.withColumn("_cell", one), rated.withColumn("_cell", one).drop(*by), "_cell", "_rows", rows.count()).drop("_cell")
    return joined.withColumn("selected", uniform(F.col("doc_id")) < F.col("probability"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, tokens, weight, probability (rounded to 6 digits), selected.

    docs(doc_id, text, lang, source, ...): a null source or language is a value of its own, shown as the empty string; a
    null or empty text has no token and a cell without tokens gives probability 0; repeated rows give a row each and are
    kept or left together; other columns are ignored, and a topic column takes the place of the derived one; an empty
    table gives no rows.
    """
    keep = ["doc_id", "text", "lang", "source", *(["topic"] if "topic" in docs.columns else [])]
    out = mix(docs.select(*keep), "text", **options)
    return out.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "selected")


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The selected rows of docs, with its columns, whatever their names; nulls, empty texts, repeated rows and empty tables as
    in mixture()."""
    clash = {c: f"_own_{c}" for c in docs.columns if c in ("weight", "probability", "selected") or c.startswith("_")}
    out = mix(docs.withColumnsRenamed(clash), **options).where("selected")
    return out.select(*(F.col(clash.get(c, c)).alias(c) for c in docs.columns))


def mixture_sql() -> str:
    """The same mixture as DuckDB SQL, sweeps written out."""
    steps = [
        rf"""rows_ as (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, text,
             coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as tokens from documents)""",
        """forms as (select doc_id, source, lang, tokens, coalesce(case when tokens = 0 then 'empty'
             when (length(text) - length(replace(text, '|', ''))) * 5 >= tokens then 'table'
             when (length(text) - length(replace(text, chr(10), ''))) * 12 >= tokens then 'lines'
             when tokens < 200 then 'short' when tokens < 1000 then 'article' else 'long' end, '') as topic from rows_)""",
        "cells as (select source, lang, topic, sum(tokens)::double as n from forms group by all)",
        "w0 as (select *, n as w, sum(n) over () as total from cells)",
    ]
    for i, d in enumerate(DIMENSIONS):
        steps.append(f"t{i}a as (select *, pow(sum(n) over (partition by {d}) / total, {EXPONENTS[d]}) as raw_{d}, count(*) over (partition by {d}) as c_{d} from {'w0' if not i else f't{i - 1}'})")
        steps.append(f"t{i} as (select *, total * raw_{d} / sum(raw_{d} / c_{d}) over () as t_{d} from t{i}a)")
    last, k = f"t{len(DIMENSIONS) - 1}", 0
    for _ in range(SWEEPS):
        for d in DIMENSIONS:
            steps.append(f"s{k} as (select * replace (case when sum(w) over (partition by {d}) > 0 then w * t_{d} / sum(w) over (partition by {d}) else 0 end as w) from {last})")
            last, k = f"s{k}", k + 1
    steps.append(f"r0 as (select *, case when n > 0 then w / n else 0 end as weight, {BUDGET}::double as rate from {last})")
    for i in range(RATE_STEPS):
        steps.append(
            f"""r{i + 1} as (select * replace (case when sum(case when weight * rate >= 1 then 0 else w end) over () > 0
             then (total * {BUDGET} - sum(case when weight * rate >= 1 then n else 0 end) over ())
                  / sum(case when weight * rate >= 1 then 0 else w end) over () else rate end as rate) from r{i})"""
        )
    return (
        "with " + ",\n".join(steps) + f"""
        select f.doc_id, f.source, f.lang, f.topic, f.tokens, round(c.weight, 6) as weight,
               round(least(1.0, c.weight * c.rate), 6) as probability,
               ('0x' || substr(md5('mix:' || coalesce(f.doc_id::varchar, '')), 1, 8))::bigint / 4294967296.0 < least(1.0, c.weight * c.rate) as selected
        from forms f join r{RATE_STEPS} c on f.source = c.source and f.lang = c.lang and f.topic = c.topic"""
    )
