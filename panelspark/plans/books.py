"""All books of the daily run in one job, with ``book`` as a key."""
from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean_nonfinite, first_match, kelly_exposure, safe_div
from ..functions.ranks import rank_columns
from ..functions.windows import add_features, series
from ..operators import cross_section as xs
from ..operators import fundamentals as fund
from ..operators import linear as lin
from ..operators import portfolio as pf
from ..operators import relative
from ..operators import technical as tech
from ..operators.decisions import decide
from ..operators.evaluate import avg_pairwise_corr
from ..operators.joins import sector_join
from ..operators.moments import collect_co_moments, greedy_prune
from ..operators.regime import _spec, classify_regime_6
from ..session import stored

c = F.col


@dataclass(frozen=True)
class Book:
    name: str
    class_cap: float
    position_cap: float
    horizons: dict = field(default_factory=lambda: {60: 0.75, 20: 0.25})
    top_quantile: float = 0.30
    kelly: float = 0.25
    bucket: str = "core"


#: fixed values: caps and horizons of the books
BOOKS = [
    Book("stocks", 0.70, 0.08),
    Book("crypto", 0.30, 0.12),
    Book("metals", 0.15, 0.10),
    Book("bonds", 0.40, 0.20),
    Book("aggressive", 0.60, 0.20, {15: 0.6, 5: 0.4}, 0.20, 0.5, "experimental"),
]


def by_book(books: Sequence[Book], value, key: Column) -> Column:
    return first_match([(key == b.name, float(value(b))) for b in books], None)


def book_levels(horizons: Sequence[int]) -> list:
    """Volatility block, the inputs of the five ranked signals, and the forward return of every horizon."""
    return [*[tech.realized_vol(w) for w in (10, 20, 60)], tech.atr_pct(), tech.parkinson_vol(), tech.yang_zhang_vol(), tech.vol_of_vol(),
            tech.log_momentum(20), tech.trend(), relative.relative_strength_column("rs_bench", "_bench"), *[xs.forward_return(h, f"fwd_{h}") for h in horizons]]


VOLATILITY = ["realized_vol_10", "realized_vol_20", "realized_vol_60", "atr_pct", "parkinson_vol", "yang_zhang_vol", "vol_of_vol"]


def book_panel(bars: DataFrame, bench: DataFrame, assignment: DataFrame, horizons: Sequence[int], sectors: DataFrame | None = None,
               filings: DataFrame | None = None, insider: DataFrame | None = None, winsorize_pct: float = 0.01,
               n_names: int | None = None) -> tuple[DataFrame, list[str]]:
    """Features and labels ``t_<h>`` of all assigned names, every book ranked, de-meaned and winsorised on its own.

    Families: volatility and the ranked signals (inside the sector when ``sectors`` is given), and the ranked
    filing ratios and insider flows when their tables are there. A label is null where its future is unknown;
    rows lacking a feature are left out.
    """
    book, ranked = ("book", "date"), []
    n_names = n_names or bars.agg(F.countDistinct("ticker").alias("n")).first().n
    group = (*book, "sector") if sectors is not None else book
    p = fund.event_columns(bars, filings, insider).join(assignment.select("ticker", "book"), "ticker")
    if sectors is not None:
        p = sector_join(p, sectors)
    p = relative.market_join(p, bench.select("date", c("close").alias("_bench")))
    levels = book_levels(horizons)
    if insider is not None:
        levels.append([{}, {}, fund.insider_columns()])
        ranked += [(x, f"i_{x}") for x in fund.INSIDER_COLS]
    if filings is not None:
        levels.append([fund.ratio_columns()])
        ranked += [(x, f"f_{x}") for x in fund.FUNDAMENTAL_COLS]
    p = add_features(p, levels)
    signals = xs.ranked_signals()
    p = p.withColumns({f"_b_{k}": v for k, v in signals.items()})
    p = rank_columns(p, {**{k: (f"_b_{k}", group) for k in signals}, **{out: (x, book) for x, out in ranked}}, ("ticker",), n_names)
    p = p.withColumns({k: c(k) - 0.5 for k in signals}).withColumns({out: F.coalesce(c(out) - 0.5, F.lit(0.0)) for _, out in ranked})
    p = p.withColumns({f"t_{h}": c(f"fwd_{h}") - F.avg(f"fwd_{h}").over(Window.partitionBy(*group)) for h in horizons})
    features = [*VOLATILITY, *signals, *[out for _, out in ranked]]
    p = clean_nonfinite(p.select("date", "pos", "ticker", "book", *features, *[f"t_{h}" for h in horizons]))
    return xs.winsorize(p, features, winsorize_pct, by=book, names=n_names).dropna(subset=features), features


def score_books(panel: DataFrame, features: Sequence[str], books: Sequence[Book], prune: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Blended scores of the last date ``(book, date, ticker, score)`` and what was fitted.

    One pass gives the moments of every book (all its rows, for the pruning) and of every book and horizon (the
    labelled rows, for the fit). A book keeps, in panel order, the features that none kept before comes closer
    to than ``prune``; all its horizons use those. ``fits(book, horizon, n_rows, features)`` has a row for every
    horizon of every book; one without labelled rows has no features, and counts 0 in the blend.
    """
    spark = panel.sparkSession
    ids = {(b.name, h): i for i, (b, h) in enumerate((b, h) for b in books for h in [None, *b.horizons])}
    segments = F.array_compact(F.array(*[
        F.when((c("book") == n) & (F.lit(h is None) | c(f"t_{h}" if h else "book").isNotNull()), F.struct(
            F.lit(i).cast("long").alias("fold"), (c(f"t_{h}") if h else F.lit(None).cast("double")).alias("target")))
        for (n, h), i in ids.items()]))
    rows = panel.select("date", "pos", "ticker", "book", *features, F.inline(segments))
    states = collect_co_moments(rows, [*features, "target"], "fold")
    table, fits = [], []
    for b in books:
        whole = states.get(ids[b.name, None])
        kept = greedy_prune(whole.corr(), features, prune) if whole else []
        for h in b.horizons:
            i = ids[b.name, h]
            fits.append((b.name, h, int(states[i].n[0, 0]) if i in states else 0, kept if i in states else []))
            if i in states:
                m = lin.Moments(features, states[i])
                w = lin.elasticnet(m, kept)
                intercept, coef = lin.raw_units(m, w, kept)
                table += [("elasticnet", i, k, float(v), float(s), intercept) for (k, v), s in zip(coef.items(), w)]
    # a book may end before the others: its own last date counts
    last = rows.groupBy("book").agg(F.max("pos").alias("_last"))
    today = panel.join(F.broadcast(last), "book").where(c("pos") == c("_last"))  # one row per book
    today = today.withColumn("fold", F.explode(first_match([
        (c("book") == b.name, F.array(*[F.lit(ids[b.name, h]).cast("long") for h in b.horizons])) for b in books], None))).withColumn("target", F.lit(None).cast("double"))
    scored = lin.score_linear(today, lin.coefficient_table(spark, table), features)
    names = {i: key for key, i in ids.items() if key[1]}
    share = {i: next(b for b in books if b.name == n) for i, (n, _) in names.items()}
    scored = scored.withColumns({
        "book": first_match([(c("fold") == i, n) for i, (n, _) in names.items()], None),
        "share": first_match([(c("fold") == i, share[i].horizons[h] / sum(share[i].horizons.values())) for i, (_, h) in names.items()], None),
    })
    z = rank_columns(scored, {"_z": ("score", ("book", "fold"))}, ("ticker",))
    blended = z.groupBy("book", "date", "ticker").agg(F.sum(c("share") * (c("_z") - 0.5)).alias("score"))
    return blended, spark.createDataFrame(fits, "book string, horizon int, n_rows long, features array<string>")


def exposure_by_date(bench: DataFrame) -> DataFrame:
    """Regime exposure and the moments of the last 60 benchmark returns per date."""
    w = _spec(())
    frame = w.rowsBetween(-59, 0)
    r = bench.withColumn("_r", safe_div(c("close"), F.lag("close").over(w)) - 1)
    stats = r.select("date", F.avg("_r").over(frame).alias("_mean"), F.var_samp("_r").over(frame).alias("_var"), F.count("_r").over(frame).alias("_n"))
    return classify_regime_6(bench).join(stats, "date")


def basket_overload(scores: DataFrame, bars: DataFrame, assignment: DataFrame, top_q: Column, threshold: float = 0.80, days: int = 60) -> DataFrame:
    """``(book, date, avg_corr, overload)``: are the names a book would pick too much alike?

    Mean pairwise correlation of the picks over the last ``days`` dates, up to the scores' date, on which every
    name of the book has a return. Picks meet their returns by the ordinal of such a date, an equality, so a pick
    reads ``days`` rows and nothing else. Baskets under two names do not overload.
    """
    returns = bars.select("date", "ticker", (safe_div(c("close"), F.lag("close").over(series())) - 1).alias("ret")).join(assignment.select("ticker", "book"), "ticker")
    names = returns.groupBy("book").agg(F.countDistinct("ticker").alias("_names"))
    whole = returns.groupBy("book", "date").agg(F.count("ret").alias("_known")).join(names, "book").where(c("_known") == c("_names"))
    place = whole.select("book", "date", F.row_number().over(Window.partitionBy("book").orderBy("date")).alias("_at"))  # one row per book and date
    asked = scores.select("book", "date").distinct().withColumn("_asked", F.lit(True))
    at = place.join(asked, ["book", "date"], "full_outer").withColumn("_at", F.last("_at", ignorenulls=True).over(Window.partitionBy("book").orderBy("date"))).where("_asked")
    picks = xs.with_pick_rank(scores.withColumn("_q", top_q), c("_q"), ("book", "date")).where("_rn <= _k").select("book", "date", "ticker")
    reads = picks.join(at, ["book", "date"]).select("book", "date", "ticker", F.explode(F.sequence(F.greatest(c("_at") - (days - 1), F.lit(1)), c("_at"))).alias("_at"))
    numbered = returns.join(place, ["book", "date"]).select("book", "ticker", "_at", "ret")
    basket = reads.withColumnRenamed("date", "_day").join(numbered, ["book", "ticker", "_at"]).withColumnRenamed("_at", "date")
    out = avg_pairwise_corr(basket, threshold, ("book", "_day"))
    return out.select("book", c("_day").alias("date"), "avg_corr", "overload")


def decide_books(scores: DataFrame, bars: DataFrame, bench: DataFrame, assignment: DataFrame, books: Sequence[Book] = BOOKS,
                 current: DataFrame | None = None, governor: DataFrame | None = None, microcaps: DataFrame | None = None, crowded: float = 0.80) -> DataFrame:
    """Governed decisions and capped weights for ``scores(book, date, ticker, score)``, any number of dates.

    Exposure = regime x (0.5 + 0.5 x fractional Kelly) x governor, halved when the picks overload; the position
    cap inside the decision, then the class cap, 5% for an experimental book, then the caps of microcaps
    (1% each, 10% together). ``current(book, ticker, weight)``, ``governor(book, exposure)``, ``microcaps(ticker)``.
    """
    top_q = by_book(books, lambda b: b.top_quantile, c("book"))
    s = scores.where("score IS NOT NULL").join(F.broadcast(exposure_by_date(bench)), "date")  # one row per trading day
    s = s.join(basket_overload(scores, bars, assignment, top_q, crowded), ["book", "date"], "left")
    if governor is not None:
        s = s.join(governor.select("book", c("exposure").alias("_gov")), "book", "left")
    else:
        s = s.withColumn("_gov", F.lit(1.0))
    if current is not None:
        s = s.join(current.select("book", "ticker", c("weight").alias("current")), ["book", "ticker"], "left")
    else:
        s = s.withColumn("current", F.lit(0.0))
    kelly = first_match([(c("book") == b.name, kelly_exposure("_mean", "_var", "_n", b.kelly)) for b in books], None)
    s = s.withColumns({
        "risk_on": c("exposure") > 0, "governor": c("exposure") * (0.5 + 0.5 * kelly) * F.coalesce("_gov", F.lit(1.0)),
        "overload": F.coalesce("overload", F.lit(False)), "strategy": c("book"),
    })
    # caps and quantiles are columns of the book, so all books pass through one plan
    out = decide(s.select("strategy", "date", "ticker", "score", "current", "risk_on", "governor", "overload"),
                 by_book(books, lambda b: b.position_cap, c("strategy")), by_book(books, lambda b: b.top_quantile, c("strategy")))
    capped = pf.rescale_book(out.withColumn("weight", c("target_weight")), by_book(
        books, lambda b: min(b.class_cap, pf.EXPERIMENTAL_CAP) if b.bucket == "experimental" else b.class_cap, c("strategy")))
    if microcaps is not None:
        listed = capped.join(microcaps.select("ticker", F.lit(True).alias("_micro")).distinct(), "ticker", "left")
        capped = pf.microcap_caps(listed, F.coalesce("_micro", F.lit(False))).drop("_micro")
    return capped.withColumnRenamed("strategy", "book")


def build_books(bars: DataFrame, bench: DataFrame, assignment: DataFrame, books: Sequence[Book] = BOOKS, current: DataFrame | None = None,
                governor: DataFrame | None = None, sectors: DataFrame | None = None, filings: DataFrame | None = None,
                insider: DataFrame | None = None, microcaps: DataFrame | None = None) -> DataFrame:
    """Decisions and capped weights of every book for its last date, from bars to weights.

    A book whose blend has no fitted horizon (no rows, or no name assigned) leaves one row without a name:
    ``NO TRADE`` for the reason ``no_model``, weight 0. The panel is written once; moments, pruning and scores read it.
    """
    horizons = sorted({h for b in books for h in b.horizons})
    panel, features = book_panel(bars, bench, assignment, horizons, sectors, filings, insider)
    scores, fits = score_books(stored(bars.sparkSession, panel, "book-panel"), features, books)
    scores = stored(bars.sparkSession, scores, "book-scores")
    out = decide_books(scores, bars, bench, assignment, books, current, governor, microcaps)
    unfit = fits.groupBy("book").agg(F.sum("n_rows").alias("_n")).where("_n = 0")
    last = bars.agg(F.max("date")).scalar()
    return out.unionByName(unfit.select("book", last.alias("date"), F.lit("NO TRADE").alias("action"), F.lit("HIGH").alias("risk_status"), F.lit("no_model").alias("reasoning"),
                                        F.lit(0.0).alias("target_weight"), F.lit(0.0).alias("weight")), allowMissingColumns=True)


def combine_system(books: DataFrame, caps: dict[str, float], multipliers: DataFrame, system_governor: float = 1.0) -> DataFrame:
    """Books under the system's caps, times their learning multiplier and the system governor."""
    cap = first_match([(c("book") == k, float(v)) for k, v in caps.items()], None)
    scaled = pf.rescale_book(books.where(c("book").isin(*caps)), cap, ("book", "date"))
    m = multipliers.select(c("sleeve").alias("book"), "multiplier")
    return scaled.join(m, "book", "left").groupBy("date", "ticker").agg(
        F.sum(c("weight") * F.coalesce("multiplier", F.lit(1.0)) * system_governor).alias("weight")).where("weight > 0")
