"""All formulas in one table, and the families that queries ask for."""

from __future__ import annotations

from tidemark.functions import evidence as e
from tidemark.functions import indicators as i

FUNDAMENTALS = ("pe_ratio", "pb_ratio", "roe", "roa", "debt_to_equity", "current_ratio", "quick_ratio", "profit_margins", "operating_margins", "ebitda_margins", "revenue_growth")

GROUPS: dict[str, dict[str, str]] = {
    "base": i.BASE, "trend": i.TREND, "momentum": i.MOMENTUM, "volume": i.VOLUME, "volatility": i.VOLATILITY, "structure": i.STRUCTURE, "relative_strength": i.RELATIVE, "cross_timeframe": i.CROSS_TIMEFRAME, "liquidity": i.LIQUIDITY,
    "gaps": i.GAPS, "risk": i.RISK, "compression": i.COMPRESSION, "statistics": i.STATISTICS, "calculus": i.CALCULUS, "calculus_short": i.CALCULUS_SHORT, "family_scores": i.SCORES,
    "family_statistics": i.FAMILY, "family_relations": i.RELATIONS, "ecosystem": i.ECOSYSTEM, "rsi_dots": e.RSI_DOTS, "ema_dots": e.EMA_DOTS, "macd_dots": e.MACD_DOTS, "candle_dots": e.CANDLE_DOTS, "volume_dots": e.VOLUME_DOTS,
    "volatility_dots": e.VOLATILITY_DOTS, "structure_dots": e.STRUCTURE_DOTS, "relative_dots": e.RELATIVE_DOTS, "gap_dots": e.GAP_DOTS, "risk_dots": e.RISK_DOTS, "cross_family": e.CROSS_FAMILY, "evidence_totals": e.TOTALS, "state": e.STATE,
}

FORMULAS: dict[str, str] = {name: text for group in GROUPS.values() for name, text in group.items()}
