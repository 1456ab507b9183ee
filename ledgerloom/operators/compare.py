"""Comparing reported figures: exact decimals, null-safe, never interpolated."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.access import scope_to_user
from ledgerloom.operators.maintenance import latest
from ledgerloom.operators.rows import with_earlier
from ledgerloom.schemas import FINANCIAL_METRICS, METRIC_NAMES
from ledgerloom.session import rows_if_bounded

# Unit names and their factors; comparison size limits.
UNIT_FACTORS = {"units": 1, "thousands": 1_000, "millions": 1_000_000, "billions": 1_000_000_000}
MIN_COMPARED, MAX_COMPARED = 2, 5
# Two reports' figures are compared pair by pair while they are together at most so many.
PART_FIGURES = 128


def growth(base: Column, other: Column) -> Column:
    """(other - base) / |base|; null when either is missing or the base is 0."""
    return F.try_divide((other - base).cast("double"), F.abs(base).cast("double"))


def _readable(analyses: DataFrame) -> DataFrame:
    """Metrics analyses per document whose result is JSON, as text."""
    # Whatever is JSON becomes a record, if one without figures, so nothing else decides.
    # An object that is never closed is sorted out by a look, as failing to parse costs more than parsing.
    closed = analyses.filter("type = 'metrics'").filter(~F.col("result").rlike(r"^\s*\{[^}]*\z"))
    valid = closed.filter(F.try_parse_json("result").isNotNull())
    return valid.select("id", "created_at", "result", F.explode("document_ids").alias("document_id"))


def _newest(analyses: DataFrame) -> DataFrame:
    """The newest analysis of every document among those that can be read; only these are taken apart, as ``r``."""
    newest = latest(_readable(analyses), "document_id", ["created_at", "id"])
    return newest.select("document_id", F.from_json("result", FINANCIAL_METRICS).alias("r"))


def _entry(metric: str, segment: Column, m: Column) -> Column:
    return F.struct(
        F.lit(metric).alias("metric"),
        segment.alias("segment"),
        m["value"].alias("value"),
        m["unit"].alias("unit"),
        m["currency"].alias("currency"),
        m["source_page"].alias("source_page"),
    )


def _figures(of: str) -> Column:
    """Entries of all metrics of a struct that were reported, be it as null."""
    figures = F.array(*[_entry(m, F.lit(None).cast("string"), F.col(f"{of}.{m}")) for m in METRIC_NAMES])
    return F.filter(figures, lambda f: f["unit"].isNotNull() | f["value"].isNotNull())


def flatten_metrics(analyses: DataFrame) -> DataFrame:
    """Latest readable metrics analysis per document as long rows; segments become rows of their own.

    Result: document_id, company, fiscal_period, metric, segment (null for company figures), value,
    unit, currency, source_page. Figures that were reported as null keep their row. An analysis that cannot
    be read hides no older one (:func:`missing_metrics` judges in the same way).
    """
    figures = _figures("r")
    segments = F.coalesce(
        F.transform("r.segments", lambda s: _entry("segment_revenue", s["name"], s)), F.slice(figures, 1, 0)
    )
    return _newest(analyses).select(
        "document_id", F.col("r.company").alias("company"), F.col("r.fiscal_period").alias("fiscal_period"),
        F.inline(F.concat(figures, segments)),
    )


def flatten_comparatives(analyses: DataFrame) -> DataFrame:
    """The figures of an earlier period that a report repeats, in the columns of :func:`flatten_metrics`.

    ``fiscal_period`` is the earlier period, ``document_id`` the report that repeats it, ``source_page`` where.
    """
    # A filter would be moved before the parsing and parse on its own.
    repeated = F.when(F.col("r.prior.fiscal_period").isNotNull(), _figures("r.prior"))
    return _newest(analyses).select(
        "document_id", F.col("r.company").alias("company"), F.col("r.prior.fiscal_period").alias("fiscal_period"), F.inline(repeated)
    )


def flatten_guidance(analyses: DataFrame) -> DataFrame:
    """Guidance in the report's own words: document_id, company, fiscal_period, position (from 1), text, source_page."""
    rows = _newest(analyses).select("document_id", "r.company", "r.fiscal_period", F.posexplode("r.guidance").alias("at", "g"))
    return rows.select(
        "document_id", "company", "fiscal_period", (F.col("at") + 1).alias("position"), F.col("g.text").alias("text"), F.col("g.source_page").alias("source_page")
    )


def restatements(metrics: DataFrame, comparatives: DataFrame) -> DataFrame:
    """What later reports say of a period against the period's own report: delta, growth, and a flag.

    One row per company, period, metric and later report. ``flag`` is ``restated`` where values differ, ``not_reported``
    where the period has no such figure of its own, else null. A period's own figures are one list, so they stay where they lie by
    company and period already.
    """
    period = ["company", "fiscal_period"]
    named = metrics.filter("segment is null") if "segment" in metrics.columns else metrics
    figure = F.struct("metric", F.col("document_id").alias("base_document_id"), F.col("value").alias("base_value"))
    own = named.dropna(subset=[*period, "metric"]).groupBy(*period).agg(F.collect_list(figure).alias("_own"))
    said = comparatives.select(*period, "metric", "document_id", F.col("value").alias("other_value"))
    same = F.filter("_own", lambda o: o["metric"] == F.col("metric"))
    sides = said.join(own, period, "left").select(*said.columns, F.inline_outer(same).alias("_metric", "base_document_id", "base_value")).drop("_metric")
    base, other = F.col("base_value"), F.col("other_value")
    flag = F.when(base.isNull() & other.isNotNull(), "not_reported").when(base != other, "restated")
    return sides.withColumn("flag", flag).withColumn("delta", other - base).withColumn("growth", growth(base, other))


def normalize_units(metrics: DataFrame, rates: DataFrame, target: str = "USD") -> DataFrame:
    """Scale values to single units and convert them to ``target``.

    ``rates`` is (currency, fiscal_period, rate into the target currency). An unknown unit or a
    missing rate gives a null value and a flag. Few rates (one bounded job finds out) are sent to the figures, which
    would else meet in a handful of tasks, one per currency and period.
    """
    factor: Column = F.lit(None).cast("decimal(12,0)")
    for unit, by in UNIT_FACTORS.items():
        factor = F.when(F.coalesce(F.col("unit"), F.lit("units")) == unit, F.lit(by).cast("decimal(12,0)")).otherwise(factor)
    rated = rates.select("currency", "fiscal_period", F.col("rate").cast("decimal(18,8)").alias("_rate"))
    few = rows_if_bounded(rated)
    if few is not None:
        rated = F.broadcast(metrics.sparkSession.createDataFrame(few, rated.schema))
    priced = metrics.join(rated, ["currency", "fiscal_period"], "left").withColumn("_rate", F.when(F.col("currency") == target, F.lit(1).cast("decimal(18,8)")).otherwise(F.col("_rate")))
    flag = F.when(F.col("value").isNull(), None).when(factor.isNull(), "unknown_unit").when(
        F.col("_rate").isNull(), "missing_rate"
    )
    scaled = (F.col("value") * factor).cast("decimal(38,4)")
    value = (scaled.cast("decimal(28,4)") * F.col("_rate")).cast("decimal(28,4)")
    return (
        priced.withColumn("flag", flag)
        .withColumn("value", F.when(F.col("flag").isNull(), value))
        .withColumn("unit", F.lit("units"))
        .withColumn("currency", F.when(F.col("flag").isNull(), F.lit(target)).otherwise(F.col("currency")))
        .select(*metrics.columns, "flag")
    )


def compare_values(pairs: DataFrame) -> DataFrame:
    """Add delta, growth and flag to rows with base_/other_ value, unit and currency."""
    base, other = F.col("base_value"), F.col("other_value")
    differs = (F.col("base_unit") != F.col("other_unit")) | (F.col("base_currency") != F.col("other_currency"))
    flag = (
        F.when(base.isNull() & other.isNull(), "missing_both")
        .when(base.isNull(), "missing_base")
        .when(other.isNull(), "missing_other")
        .when(differs, "unit_mismatch")
    )
    comparable = F.col("flag").isNull()
    return (
        pairs.withColumn("flag", flag)
        .withColumn("delta", F.when(comparable, other - base))
        .withColumn("growth", F.when(comparable, growth(base, other)))
    )


def _segment(metrics: DataFrame) -> list[str]:
    """A figure is named by its metric, and by its segment where the rows have one."""
    return [c for c in metrics.columns if c == "segment"]


def _side_by_side(base: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join in which null keys meet, with each key once."""
    left = base.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys]
    return left.join(other, same, "full_outer").select(
        *[F.coalesce(k, f"_{k}").alias(k) for k in keys],
        *[c for df in (base, other) for c in df.columns if c not in keys],
    )


def metric_deltas(metrics: DataFrame, base_doc: object, other_docs: Sequence[object]) -> DataFrame:
    """Per metric (and segment) and other document: base and other value, delta and growth.

    A metric missing on one side keeps its row with a flag; so does one in another unit or currency.
    """
    cols = ("value", "unit", "currency")
    named = ["metric", *_segment(metrics)]
    base = metrics.filter(F.col("document_id") == F.lit(base_doc)).select(
        *named, F.col("document_id").alias("base_document_id"), *[F.col(c).alias(f"base_{c}") for c in cols]
    )
    # One copy of the base per other document, so that a metric missing over there still shows.
    base = base.withColumn("document_id", F.explode(F.lit(list(other_docs))))
    other = metrics.filter(F.col("document_id").isin(list(other_docs))).select(
        *named, "document_id", *[F.col(c).alias(f"other_{c}") for c in cols]
    )
    return compare_values(_side_by_side(base, other, [*named, "document_id"]))


def period_deltas(metrics: DataFrame, ordinal: Column, lag_periods: int = 1, together: bool = False) -> DataFrame:
    """:func:`metric_deltas` of every report against its own company's report ``lag_periods`` earlier.

    A figure of the earlier report that the later one lacks keeps a row under the later document. A report's figures
    travel together, once, to its company's other reports, where the two lists are compared. With ``together`` the rows are
    known to lie by company already (``repartition("company")``, or grouped after it), so that they do not travel at all.
    """
    cols = ("value", "unit", "currency")
    named = ["metric", *_segment(metrics)]
    rows = metrics.withColumn("period_no", ordinal)
    # What names no company or period has no earlier report and is none, so it is not brought together at all.
    placed = F.col("company").isNotNull() & F.col("period_no").isNotNull()
    where = list(dict.fromkeys(["company", *(c for c in ("fiscal_period",) if c in metrics.columns), "period_no", "document_id"]))
    figure, report = F.collect_list(F.struct(*named, *cols)), ("company", "period_no", "document_id")
    if together:
        reports = rows.filter(placed).groupBy(*report).agg(figure.alias("_other"))
    else:
        listed = rows.filter(placed).groupBy(*where).agg(figure.alias("_f")).repartition("company")
        reports = listed.groupBy(*report).agg(F.flatten(F.collect_list("_f")).alias("_other"))
    earlier = Window.partitionBy("company").orderBy("period_no").rangeBetween(-lag_periods, -lag_periods)
    based = F.struct(F.col("document_id").alias("base_document_id"), F.col("_other").alias("f"))
    own = lambda r: F.transform(r["f"], lambda f: F.struct(r["base_document_id"], *[f[c].alias(c) for c in (*named, *cols)]))
    both = reports.withColumn("_before", F.collect_list(based).over(earlier))
    both = both.withColumn("_base", F.flatten(F.transform("_before", own))).drop("_before")
    met = _met(both, named).select(
        "company", *[F.coalesce(F.col(f"_o.{c}"), F.col(f"_b.{c}")).alias(c) for c in named], "period_no", "document_id",
        "_b.base_document_id", *[F.col(f"_b.{c}").alias(f"base_{c}") for c in cols], *[F.col(f"_o.{c}").alias(f"other_{c}") for c in cols],
    )
    nowhere = rows.filter(~placed).select(
        "company", *named, "period_no", "document_id", *[F.lit(None).cast(met.schema[c].dataType).alias(c) for c in ("base_document_id", *(f"base_{c}" for c in cols))],
        *[F.col(c).alias(f"other_{c}") for c in cols],
    )
    return compare_values(met.unionByName(nowhere))


def _met(both: DataFrame, named: Sequence[str]) -> DataFrame:
    """Full outer join, within each row, of the lists ``_base`` and ``_other`` on ``named`` (nulls meet), as ``_b`` and ``_o``.

    Long lists are dealt to parts by a hash of their names first, so that few pairs are looked at.
    """
    rest = [c for c in both.columns if c not in ("_base", "_other")]
    parts = F.ceil((F.size("_base") + F.size("_other")) / PART_FIGURES).cast("int")
    name = lambda f: F.xxhash64(*[f[c] for c in named])
    share = lambda c, i: F.filter(c, lambda f: F.pmod(name(f), parts) == i).alias(c)
    whole = F.array(F.struct("_base", "_other"))
    dealt = F.when(parts <= 1, whole).otherwise(
        F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(share("_base", i), share("_other", i)))
    )

    def same(f: Column, g: Column) -> Column:
        return reduce(and_, [f[c].eqNullSafe(g[c]) for c in named])

    def pairs(part: Column) -> Column:
        base, other = part["_base"], part["_other"]
        nobody = lambda side: F.lit(None).cast(both.schema[side].dataType.elementType)
        there = lambda o: F.filter(base, lambda b: same(o, b))
        ours = F.transform(
            other,
            lambda o: F.transform(
                F.when(F.exists(base, lambda b: same(o, b)), there(o)).otherwise(F.array(nobody("_base"))),
                lambda b: F.struct(b.alias("_b"), o.alias("_o")),
            ),
        )
        lost = F.filter(base, lambda b: ~F.exists(other, lambda o: same(o, b)))
        return F.concat(F.flatten(ours), F.transform(lost, lambda b: F.struct(b.alias("_b"), nobody("_other").alias("_o"))))

    return both.select(*rest, F.explode(dealt).alias("_part")).select(*rest, F.inline(pairs(F.col("_part"))))


def quarter_ordinal(period: Column) -> Column:
    """``2025Q3`` or ``FY2025Q3`` as a number that grows by one per quarter; else null."""
    year = F.regexp_extract(period, r"(\d{4})Q([1-4])$", 1).try_cast("int")
    quarter = F.regexp_extract(period, r"(\d{4})Q([1-4])$", 2).try_cast("int")
    return year * 4 + quarter - 1


def year_ordinal(period: Column) -> Column:
    """``FY2025`` as 2025; else null."""
    return F.regexp_extract(period, r"^(?:FY)?(\d{4})$", 1).try_cast("int")


def growth_series(metrics: DataFrame, lag_periods: int = 1, ordinal: Column | None = None) -> DataFrame:
    """Per company and metric (and segment): value, value ``lag_periods`` earlier, delta, growth.

    A gap in the periods gives null rather than the nearest report. Periods are spread over tasks,
    a company with a long history is no hot key. Year on year over quarters is a lag of 4.
    """
    position = quarter_ordinal(F.col("fiscal_period")) if ordinal is None else ordinal
    named = ["company", "metric", *_segment(metrics)]
    rows = metrics.select(*named, position.alias("period_no"), "fiscal_period", "value").filter("period_no is not null")
    paired = with_earlier(rows, named, "period_no", lag_periods, {"previous": "value"})
    now, before = F.col("value"), F.col("previous")
    return paired.withColumn("delta", now - before).withColumn("growth", growth(before, now))


def compare_matrix(
    metrics: DataFrame, doc_ids: Sequence[str], documents: DataFrame | None = None, user_id: object = None
) -> DataFrame:
    """Metric rows × document columns, with each document's rank (1 = highest value).

    Two to five documents. With ``documents`` the documents of other owners contribute nothing.
    """
    ids = list(dict.fromkeys(doc_ids))
    if not MIN_COMPARED <= len(ids) <= MAX_COMPARED:
        raise ValueError(f"compare {MIN_COMPARED} to {MAX_COMPARED} documents, got {len(ids)}")
    chosen = metrics.filter(F.col("document_id").isin(ids))
    if documents is not None:
        own = scope_to_user(documents, user_id).select(F.col("id").alias("document_id"))
        chosen = chosen.join(own, "document_id", "left_semi")
    wide = chosen.groupBy("metric").agg(
        *[F.max(F.when(F.col("document_id") == d, F.col("value"))).alias(d) for d in ids]
    )

    def rank(d: str) -> Column:
        higher = F.filter(F.array_distinct(F.array(*[F.col(f"`{o}`") for o in ids])), lambda v: v > F.col(f"`{d}`"))
        return F.when(F.col(f"`{d}`").isNotNull(), F.size(higher) + 1).alias(f"rank_{d}")

    return wide.select("metric", *[F.col(f"`{d}`") for d in ids], *[rank(d) for d in ids])


def compare_many(metrics: DataFrame, comparisons: DataFrame) -> DataFrame:
    """:func:`compare_matrix` for many comparisons: (comparison_id, metric, value_1.., rank_1..).

    ``comparisons`` is (comparison_id, slot 1 to 5, document_id); a slot nobody fills stays null. Another
    slot, or two documents with the same metric in one slot, fail the job.
    """
    slots = range(1, MAX_COMPARED + 1)
    known = F.when(F.col("slot").between(1, MAX_COMPARED), F.col("slot")).otherwise(
        F.raise_error(F.lit(f"a comparison's slot is not between 1 and {MAX_COMPARED}")).cast("int")
    )
    placed = metrics.select("document_id", "metric", "value").join(comparisons.withColumn("slot", known), "document_id")

    def alone(s: int) -> Column:
        # Numbers, unlike texts, are kept in place by the aggregation, which then needs no sort.
        here = F.when(F.col("slot") == s, F.xxhash64("document_id"))
        value = F.max(F.when(F.col("slot") == s, F.col("value")))
        clash = F.raise_error(F.lit("two documents share a comparison's slot")).cast("double")
        return F.when(F.min(here) < F.max(here), clash.cast(value_type)).otherwise(value).alias(f"value_{s}")

    value_type = dict(metrics.dtypes)["value"]
    wide = placed.groupBy("comparison_id", "metric").agg(*[alone(s) for s in slots])
    values = F.array_compact(F.array_distinct(F.array(*[f"value_{s}" for s in slots])))

    def rank(s: int) -> Column:
        own = F.col(f"value_{s}")
        return F.when(own.isNotNull(), F.size(F.filter(values, lambda v: v > own)) + 1).alias(f"rank_{s}")

    return wide.select("*", *[rank(s) for s in slots])


def margins(metrics: DataFrame) -> DataFrame:
    """Gross, operating and net margin per document; null propagates, revenue 0 gives null."""
    names = ("revenue", "gross_income", "operating_income", "net_income")
    wide = metrics.groupBy("document_id", "company", "fiscal_period").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names]
    )

    def share(m: str) -> Column:
        return F.try_divide(F.col(m).cast("double"), F.col("revenue").cast("double"))

    return wide.select(
        "document_id", "company", "fiscal_period",
        share("gross_income").alias("gross_margin"),
        share("operating_income").alias("operating_margin"),
        share("net_income").alias("net_margin"),
    )


def segment_mix(segments: DataFrame, reported: DataFrame | None = None, lag_periods: int = 1) -> DataFrame:
    """Each segment's share of its company's segment total, and the change of that share.

    ``segments`` is (company, fiscal_period, segment, value); ``reported`` (company, fiscal_period,
    value) adds the gap between the segment sum and the reported total.
    """
    totals = segments.groupBy("company", "fiscal_period").agg(F.sum("value").alias("segment_total"))
    if reported is not None:
        totals = totals.join(
            reported.select("company", "fiscal_period", F.col("value").alias("reported_total")),
            ["company", "fiscal_period"],
            "left",
        ).withColumn("unexplained", F.col("reported_total") - F.col("segment_total"))
    shares = segments.join(totals, ["company", "fiscal_period"]).withColumn(
        "share", F.try_divide(F.col("value").cast("double"), F.col("segment_total").cast("double"))
    )
    numbered = shares.withColumn("period_no", quarter_ordinal(F.col("fiscal_period")))
    paired = with_earlier(numbered, ["company", "segment"], "period_no", lag_periods, {"previous_share": "share"})
    return paired.withColumn("share_change", F.col("share") - F.col("previous_share"))


def missing_metrics(documents: DataFrame, analyses: DataFrame) -> DataFrame:
    """Documents without a stored metrics analysis that can be read; what :func:`flatten_metrics` skips does not count."""
    if "result" in analyses.columns:
        done = _readable(analyses.withColumns({c: F.lit(None) for c in ("id", "created_at") if c not in analyses.columns})).select("document_id")
    else:
        done = analyses.filter("type = 'metrics'").select(F.explode("document_ids").alias("document_id"))
    return documents.join(done.select(F.col("document_id").alias("id")).distinct(), "id", "left_anti")


def _named_by(by: Sequence[str], names: Sequence[Sequence[object]]) -> Column:
    """Whether a row has one of the ``names`` in the columns ``by``, or a null there; never null itself."""
    unnamed = reduce(or_, [F.col(c).isNull() for c in by])
    if not names:
        return unnamed
    if len(by) == 1:
        return unnamed | F.col(by[0]).isin([n[0] for n in names])
    return unnamed | reduce(or_, [reduce(and_, [F.col(c) == F.lit(v) for c, v in zip(by, n)]) for n in names])


def comparison_result(
    deltas: DataFrame, evidence: DataFrame, by: Sequence[str] = ("comparison_id",), together: Sequence[str] = ()
) -> DataFrame:
    """One JSON record per comparison: its table of deltas, its evidence and its documents.

    ``deltas`` is (*by, document_id, metric, ...), ``evidence`` (*by, document_id, chunk_id, ...).
    A comparison holds at most five documents, so both lists are bounded. A document that others are compared with
    (``base_document_id`` in ``deltas``) is one of them.

    ``together`` names columns of ``deltas`` by which its rows lie together already (``repartition("company")``, or
    grouped after it) and of which a comparison with a name has one value. While few comparisons have evidence (one bounded
    job finds out), only the deltas of these, and those without a name, travel to meet it; the others are put together where they lie.
    """
    by = list(by)

    def packed(df: DataFrame, first: Sequence[str], name: str, where: Sequence[str] = ()) -> DataFrame:
        rest = [c for c in df.columns if c not in (*by, *first)]
        return df.groupBy(*where, *by).agg(F.array_sort(F.collect_list(F.struct(*first, *rest))).alias(name)).select(*by, name)

    chunks = packed(evidence, ["document_id", "chunk_id"], "evidence")
    few = rows_if_bounded(evidence.select(*by).dropna().distinct()) if together else None
    told = None if few is None else _named_by(by, few)
    met = deltas if told is None else deltas.filter(told)
    both = packed(met, ["metric", "document_id"], "table").join(chunks, by, "full_outer")
    if told is not None:
        alone = packed(deltas.filter(~told), ["metric", "document_id"], "table", [c for c in together if c not in by])
        both = both.unionByName(alone.withColumn("evidence", F.lit(None).cast(chunks.schema["evidence"].dataType)))

    def taken(c: str) -> Column:
        return F.coalesce(F.array_compact(F.transform("table", lambda r: r[c])), F.expr("cast(array() as array<string>)"))

    ids = F.array_sort(
        F.array_distinct(
            F.concat(
                *[taken(c) for c in ("document_id", "base_document_id") if c in deltas.columns],
                F.coalesce(F.transform("evidence", lambda r: r["document_id"]), F.expr("cast(array() as array<string>)")),
            )
        )
    )
    record = F.to_json(F.struct(ids.alias("document_ids"), "table", "evidence"))
    return both.select(*by, ids.alias("document_ids"), record.alias("result"))
