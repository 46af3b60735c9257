"""Feature tables: bars in, named indicator columns out, with the conditional probabilities of market states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.library import FORMULAS, FUNDAMENTALS
from tidemark.operators.resample import with_coarse, with_coarse_sql
from tidemark.plans import engine
from tidemark.plans.formula import Compiler

BAR_COLUMNS = ["symbol", "dt", "Open", "High", "Low", "Close", "Volume", "Market", "Sector"]
COARSE_COLUMNS = ["Weekly_RSI", "Weekly_MACD_Hist", "Weekly_EMA20_Slope", "Weekly_Trend_State", "Monthly_EMA20_Slope"]

#: What is counted of a state's earlier rows; r is the return after a row. The window is the state's rows before this one, or for moves before the last.
_COUNTS = {
    "S_N": ("count(r)", 1), "S_Up": ("count(CASE WHEN r > 1e-3 THEN 1 END)", 1), "S_Down": ("count(CASE WHEN r < -1e-3 THEN 1 END)", 1), "S_Sum": ("sum(r)", 1), "S_Abs": ("sum(abs(r))", 1),
    "S_SumUp": ("sum(CASE WHEN r > 1e-3 THEN r END)", 1), "S_SumDown": ("sum(CASE WHEN r < -1e-3 THEN r END)", 1), "T_N": ("count(s2)", 2), "T_Same": ("count(CASE WHEN s2 = state THEN 1 END)", 2),
    "T_Breakout": ("count(CASE WHEN floor(s2 / 27e0) = 2e0 AND (s2 - 9e0 * floor(s2 / 9e0)) >= 3e0 THEN 1 END)", 2),
    "T_Breakdown": ("count(CASE WHEN floor(s2 / 27e0) = 0e0 AND (s2 - 9e0 * floor(s2 / 9e0)) >= 3e0 THEN 1 END)", 2),
    "T_Middle": ("count(CASE WHEN floor(s2 / 27e0) = 1e0 THEN 1 END)", 2), "T_Loud": ("count(CASE WHEN (s2 - 27e0 * floor(s2 / 27e0)) >= 18e0 THEN 1 END)", 2), "T_Quiet": ("count(CASE WHEN (s2 - 27e0 * floor(s2 / 27e0)) < 9e0 THEN 1 END)", 2),
}

#: Conditional probabilities from the counts; without any, even odds.
STATE_FORMULAS = {
    "Seen": "S_N > 0",
    "Ecosystem_State_Frequency": "case(S_N > 0, safe(S_N, All_N), 0)",
    "Ecosystem_State_Rarity": "1 - Ecosystem_State_Frequency",
    "P_Up_Given_Ecosystem_State": "(S_Up + 1) / (S_N + 3)",
    "P_Down_Given_Ecosystem_State": "(S_Down + 1) / (S_N + 3)",
    "P_Flat_Given_Ecosystem_State": "(S_N - S_Up - S_Down + 1) / (S_N + 3)",
    "Expected_Return_Given_Ecosystem_State": "case(S_N > 0, S_Sum / S_N, 0)",
    "Expected_AbsReturn_Given_Ecosystem_State": "case(S_N > 0, S_Abs / S_N, 0)",
    "Expected_Downside_Given_Ecosystem_State": "safe(S_SumDown, S_Down)",
    "Expected_Upside_Given_Ecosystem_State": "safe(S_SumUp, S_Up)",
    "WinLoss_Odds_Given_Ecosystem_State": "case(S_N > 0, safe(P_Up_Given_Ecosystem_State, P_Down_Given_Ecosystem_State), 1)",
    "Payoff_Ratio_Given_Ecosystem_State": "case(S_N > 0, safe(Expected_Upside_Given_Ecosystem_State, abs(Expected_Downside_Given_Ecosystem_State)), 1)",
    "Ecosystem_Edge": "case(S_N > 0, P_Up_Given_Ecosystem_State * Expected_Upside_Given_Ecosystem_State - P_Down_Given_Ecosystem_State * abs(Expected_Downside_Given_Ecosystem_State), 0)",
    "Ecosystem_Uncertainty": "case(S_N > 0, 1 - largest(P_Up_Given_Ecosystem_State, P_Down_Given_Ecosystem_State, P_Flat_Given_Ecosystem_State), 1)",
    "Prob_State_Continuation": "case(T_N > 0, T_Same / T_N, 0.5)",
    "Prob_State_Reversal": "1 - Prob_State_Continuation",
    "Prob_Breakout_Transition": "case(T_N > 0, T_Breakout / T_N, 1 / 3)",
    "Prob_Breakdown_Transition": "case(T_N > 0, T_Breakdown / T_N, 1 / 3)",
    "Prob_MeanReversion_Transition": "case(T_N > 0, T_Middle / T_N, 1 / 3)",
    "Prob_Volatility_Expansion": "case(T_N > 0, T_Loud / T_N, 0.5)",
    "Prob_Volatility_Compression": "case(T_N > 0, T_Quiet / T_N, 0.5)",
    "State_Sample_Confidence": "S_N / (S_N + 20)",
    "State_Probability_Stability": "1 / (abs(z(P_Up_Given_Ecosystem_State, 60)) + 1)",
    "State_Edge_Stability": "1 / (std(Ecosystem_Edge, 60) + EPS)",
}
del STATE_FORMULAS["Seen"]


def _count_text(dialect: str) -> list[str]:
    out = []
    for name, (value, back) in _COUNTS.items():
        out.append(f"CAST(coalesce({value} OVER (PARTITION BY symbol, state ORDER BY n RANGE BETWEEN UNBOUNDED PRECEDING AND {back} PRECEDING), 0) AS DOUBLE) AS {name}")
    out.append("CAST(coalesce(count(r) OVER (PARTITION BY symbol ORDER BY n RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS All_N")
    return out


def needs_coarse(names: list[str]) -> bool:
    compiler = Compiler(FORMULAS, {*BAR_COLUMNS, *COARSE_COLUMNS, "rn"})
    return any(set(COARSE_COLUMNS) & c.reads for level in compiler.levels(names) for c in level)


def features(bars: DataFrame, names: list[str]) -> DataFrame:
    """``bars`` (with Market and Sector) to symbol, dt and the named columns."""
    coarse = needs_coarse(names) or bool(set(names) & set(COARSE_COLUMNS))
    return engine.compute(with_coarse(bars) if coarse else engine.by_key(bars), FORMULAS, names).select("symbol", "dt", *names)


def features_sql(bars: str, names: list[str]) -> str:
    coarse = needs_coarse(names) or bool(set(names) & set(COARSE_COLUMNS))
    base = with_coarse_sql(bars, BAR_COLUMNS) if coarse else bars
    return engine.statement(base, [*BAR_COLUMNS, *(COARSE_COLUMNS if coarse else [])], FORMULAS, names)


def state_probabilities(bars: DataFrame, names: list[str]) -> DataFrame:
    """Probabilities of what follows a market state, from earlier rows only."""
    series = Window.partitionBy("symbol").orderBy("dt")
    rows = features(bars, ["Ecosystem_State_ID", "LogRet"]).withColumnRenamed("Ecosystem_State_ID", "state")
    rows = rows.select("symbol", "dt", "state", F.row_number().over(series).alias("n"), F.lead("LogRet").over(series).alias("r"), F.lead("state").over(series).alias("s2"))
    counted = rows.selectExpr("symbol", "dt", "state", *_count_text("spark"))
    return engine.compute(counted, STATE_FORMULAS, names).select("symbol", "dt", F.col("state").alias("Ecosystem_State_ID"), *names)


def state_probabilities_sql(bars: str, names: list[str]) -> str:
    rows = f"SELECT symbol, dt, Ecosystem_State_ID AS state, row_number() OVER w AS n, lead(LogRet) OVER w AS r, lead(Ecosystem_State_ID) OVER w AS s2 FROM ({features_sql(bars, ['Ecosystem_State_ID', 'LogRet'])}) WINDOW w AS (PARTITION BY symbol ORDER BY dt)"
    counted = f"SELECT symbol, dt, state, {', '.join(_count_text('duckdb'))} FROM ({rows})"
    inner = engine.statement(counted, ["symbol", "dt", "state", *_COUNTS, "All_N"], STATE_FORMULAS, ["state", *names], prefix="p")
    return f"SELECT symbol, dt, state AS Ecosystem_State_ID, {', '.join(names)} FROM ({inner})"


def finish(table: DataFrame, columns: list[str], causal: bool = False) -> DataFrame:
    """Infinite values and NaN to NULL, then each column filled from before and, unless ``causal``, what is left from after; rows without a close go. Fundamentals without any value are zero."""
    series = Window.partitionBy("symbol").orderBy("dt")
    clean = table.select(*[c for c in table.columns if c not in columns], *[F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) for c in columns])
    past, future = series.rowsBetween(Window.unboundedPreceding, 0), series.rowsBetween(0, Window.unboundedFollowing)
    filled = clean.select(*[c for c in table.columns if c not in columns], *[F.last(c, True).over(past).alias(c) for c in columns])
    if not causal:
        filled = filled.select(*[c for c in table.columns if c not in columns], *[F.coalesce(c, F.first(c, True).over(future)).alias(c) for c in columns])
    zero = [c for c in columns if c in FUNDAMENTALS]
    out = filled.fillna(0.0, zero) if zero else filled
    return out.filter(F.col("Close").isNotNull()) if "Close" in out.columns else out


def ipo_recent(bars: DataFrame, as_of: str, days: int = 730) -> DataFrame:
    """A flag for symbols first seen less than ``days`` before ``as_of``; with fewer than two dates it is set."""
    return bars.groupBy("symbol").agg(F.min("dt").alias("listed"), F.countDistinct("dt").alias("dates")).select(
        "symbol", "listed", ((F.col("dates") < 2) | (F.datediff(F.lit(as_of).cast("date"), "listed") < days)).cast("double").alias("IPO_Recent_Flag"),
    )
