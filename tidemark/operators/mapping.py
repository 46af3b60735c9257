"""Mapping of texts and numbers to categories: sectors, indices, volatility levels and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Levels with their lower bounds, sectors in order of their bucket numbers, and keywords in order of preference.
LEVELS = {"VERY_LOW": 0.0, "LOW": 0.2, "MEDIUM": 0.3, "HIGH": 0.4, "VERY_HIGH": 0.6}
SECTORS = ("BANKING", "IT", "PHARMA", "ENERGY", "AUTO", "FMCG", "METAL", "INFRA", "TEXTILE", "CHEMICAL", "REALTY", "MEDIA", "TELECOM", "POWER", "CONSUMER_DURABLES")
KEYWORDS = (
    ("bank", "BANKING"),
    ("financ", "BANKING"),
    ("nbfc", "BANKING"),
    ("information technology", "IT"),
    ("software", "IT"),
    ("tech", "IT"),
    ("pharma", "PHARMA"),
    ("hospital", "PHARMA"),
    ("health", "PHARMA"),
    ("oil", "ENERGY"),
    ("gas", "ENERGY"),
    ("energy", "ENERGY"),
    ("power", "ENERGY"),
    ("auto", "AUTO"),
    ("vehicle", "AUTO"),
    ("tyre", "AUTO"),
    ("fmcg", "FMCG"),
    ("consumer", "FMCG"),
    ("food", "FMCG"),
    ("beverage", "FMCG"),
    ("metal", "METAL"),
    ("steel", "METAL"),
    ("mining", "METAL"),
    ("alumin", "METAL"),
    ("infra", "INFRA"),
    ("construct", "INFRA"),
    ("cement", "INFRA"),
    ("road", "INFRA"),
    ("textile", "TEXTILE"),
    ("apparel", "TEXTILE"),
    ("garment", "TEXTILE"),
    ("chemical", "CHEMICAL"),
    ("fertilizer", "CHEMICAL"),
    ("pesticide", "CHEMICAL"),
    ("realty", "REALTY"),
    ("real estate", "REALTY"),
    ("media", "MEDIA"),
    ("entertainment", "MEDIA"),
    ("broadcast", "MEDIA"),
    ("telecom", "TELECOM"),
    ("communication", "TELECOM"),
    ("utility", "POWER"),
    ("electric", "POWER"),
    ("consumer durable", "CONSUMER_DURABLES"),
    ("appliance", "CONSUMER_DURABLES"),
)
# Rules for a symbol's index in order, each the index and the words that the sector or industry must contain.
INDEX_RULES = (
    ("NIFTY_PRIVATE_BANK", (("sector", "bank"), ("industry", "private"),)),
    ("NIFTY_PRIVATE_BANK", (("sector", "bank"), ("sector", "private"),)),
    ("NIFTY_PRIVATE_BANK", (("industry", "bank"), ("industry", "private"),)),
    ("NIFTY_PRIVATE_BANK", (("industry", "bank"), ("sector", "private"),)),
    ("NIFTY_PSU_BANK", (("sector", "bank"), ("industry", "public"),)),
    ("NIFTY_PSU_BANK", (("sector", "bank"), ("industry", "psu"),)),
    ("NIFTY_PSU_BANK", (("industry", "bank"), ("industry", "public"),)),
    ("NIFTY_PSU_BANK", (("industry", "bank"), ("industry", "psu"),)),
    ("BANKNIFTY", (("sector", "bank"),)),
    ("BANKNIFTY", (("industry", "bank"),)),
    ("NIFTY_FIN_SERVICE", (("sector", "financial"),)),
    ("NIFTY_FIN_SERVICE", (("industry", "finance"),)),
    ("NIFTY_IT", (("sector", "technology"),)),
    ("NIFTY_IT", (("industry", "software"),)),
    ("NIFTY_IT", (("industry", "it services"),)),
    ("NIFTY_MIDSMALL_IT_TELECOM", (("sector", "telecom"),)),
    ("NIFTY_MIDSMALL_IT_TELECOM", (("industry", "telecom"),)),
    ("NIFTY_CONSUMER_DURABLES", (("sector", "consumer"), ("sector", "durables"),)),
    ("NIFTY_FMCG", (("sector", "fmcg"),)),
    ("NIFTY_FMCG", (("sector", "consumer goods"),)),
    ("NIFTY_FMCG", (("industry", "food"),)),
    ("NIFTY_AUTO", (("sector", "auto"),)),
    ("NIFTY_AUTO", (("industry", "automobile"),)),
    ("NIFTY_METAL", (("sector", "metal"),)),
    ("NIFTY_METAL", (("industry", "steel"),)),
    ("NIFTY_METAL", (("industry", "aluminium"),)),
    ("NIFTY_CHEMICALS", (("sector", "chemical"),)),
    ("NIFTY_CHEMICALS", (("industry", "chemical"),)),
    ("NIFTY_DEFENCE", (("sector", "defence"),)),
    ("NIFTY_DEFENCE", (("industry", "defence"),)),
    ("NIFTY_DEFENCE", (("industry", "aerospace"),)),
    ("NIFTY_ENERGY", (("sector", "energy"),)),
    ("NIFTY_ENERGY", (("industry", "power"),)),
    ("NIFTY_ENERGY", (("sector", "utilities"),)),
    ("NIFTY_OIL_GAS", (("sector", "oil"),)),
    ("NIFTY_OIL_GAS", (("sector", "gas"),)),
    ("NIFTY_OIL_GAS", (("industry", "petroleum"),)),
    ("NIFTY_PHARMA", (("sector", "pharma"),)),
    ("NIFTY_PHARMA", (("industry", "pharmaceutical"),)),
    ("NIFTY_HEALTHCARE", (("sector", "health"),)),
    ("NIFTY_HEALTHCARE", (("industry", "hospital"),)),
    ("NIFTY_MEDIA", (("sector", "media"),)),
    ("NIFTY_MEDIA", (("industry", "entertainment"),)),
    ("NIFTY_REALTY", (("sector", "real estate"),)),
    ("NIFTY_REALTY", (("sector", "realty"),)),
)


def sector_of(sector: Column, industry: Column) -> Column:
    """The sector of the first keyword found in either text; GENERIC without one."""
    text = F.lower(F.concat_ws(" ", sector, industry))
    out = F.lit("GENERIC")
    for word, name in reversed(KEYWORDS):
        out = F.when(F.contains(text, F.lit(word)), F.lit(name)).otherwise(out)
    return out


def sector_of_sql(sector: str, industry: str) -> str:
    text = f"lower(concat_ws(' ', {sector}, {industry}))"
    return "CASE " + " ".join(f"WHEN contains({text}, '{w}') THEN '{n}'" for w, n in KEYWORDS) + " ELSE 'GENERIC' END"


def index_of(sector: Column, industry: Column) -> Column:
    """The index that a symbol is held against; NIFTY50 without a rule."""
    texts = {"sector": F.lower(F.trim(F.coalesce(sector, F.lit("nan")))), "industry": F.lower(F.trim(F.coalesce(industry, F.lit("nan"))))}
    out = F.lit("NIFTY50")
    for name, words in reversed(INDEX_RULES):
        met = F.lit(True)
        for side, word in words:
            met = met & F.contains(texts[side], F.lit(word))
        out = F.when(met, F.lit(name)).otherwise(out)
    return out


def index_of_sql(sector: str, industry: str) -> str:
    texts = {"sector": f"lower(trim(coalesce({sector}, 'nan')))", "industry": f"lower(trim(coalesce({industry}, 'nan')))"}
    whens = [f"WHEN {' AND '.join(f"contains({texts[side]}, '{word}')" for side, word in words)} THEN '{name}'" for name, words in INDEX_RULES]
    return f"CASE {' '.join(whens)} ELSE 'NIFTY50' END"


def cap_index(cap: Column) -> Column:
    """Large above 100,000 crores of 10 million, mid above 50,000; unknown and zero are mid."""
    crores = cap / 10_000_000
    return F.when(cap.isNull() | (cap == 0), "NIFTY_MIDCAP").when(crores > 100_000, "NIFTY_LARGECAP").when(crores > 50_000, "NIFTY_MIDCAP").otherwise("NIFTY_SMALLCAP")


def level_of(volatility: Column) -> Column:
    """The highest level whose bound the volatility reaches."""
    out = F.lit("VERY_LOW")
    for name, bound in list(LEVELS.items())[1:]:
        out = F.when(volatility >= bound, name).otherwise(out)
    return out


def level_of_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {b}e0 THEN '{n}'" for n, b in reversed(list(LEVELS.items())[1:])) + " ELSE 'VERY_LOW' END"


def annual_volatility(bars: DataFrame, days: int = 252) -> DataFrame:
    """By symbol: the deviation of the last log returns over a year, within [0.05, 1.5]; 0.3 below 20 of them."""
    w = Window.partitionBy("symbol").orderBy("dt")
    returns = bars.withColumn("r", F.ln(F.try_divide(F.col("Close"), F.lag("Close").over(w))))
    last = returns.filter("r IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("dt")))).filter(F.col("k") <= days)
    made = last.groupBy("symbol").agg(F.count("r").alias("n"), (F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("v"))
    every = bars.select("symbol").distinct().join(made, "symbol", "left")
    return every.select("symbol", F.when(F.coalesce("n", F.lit(0)) < 20, 0.3).otherwise(F.least(F.greatest("v", F.lit(0.05)), F.lit(1.5))).alias("annual_vol"))


def bucket_number(level: Column, sector: Column) -> Column:
    """BUCKET_1 to BUCKET_75 by level and sector, 76 and 77 for generic ones of the extreme levels, 78 for the rest that is unknown."""
    known = F.array_position(F.array(*map(F.lit, LEVELS)), level), F.array_position(F.array(*map(F.lit, SECTORS)), sector)
    number = (known[0] - 1) * len(SECTORS) + known[1]
    generic = F.when((sector == "GENERIC") & (level == "VERY_HIGH"), 76).when((sector == "GENERIC") & (level == "VERY_LOW"), 77).otherwise(78)
    return F.concat(F.lit("BUCKET_"), F.when((known[0] > 0) & (known[1] > 0), number).otherwise(generic).cast("string"))


def bucket_number_sql(level: str, sector: str) -> str:
    a, b = f"list_position([{', '.join(repr(x) for x in LEVELS)}], {level})", f"list_position([{', '.join(repr(x) for x in SECTORS)}], {sector})"
    generic = f"CASE WHEN {sector} = 'GENERIC' AND {level} = 'VERY_HIGH' THEN 76 WHEN {sector} = 'GENERIC' AND {level} = 'VERY_LOW' THEN 77 ELSE 78 END"
    return f"'BUCKET_' || CAST(CASE WHEN {a} > 0 AND {b} > 0 THEN ({a} - 1) * {len(SECTORS)} + {b} ELSE {generic} END AS VARCHAR)"


def merge_small(members: DataFrame, least: int = 20) -> DataFrame:
    """(level, sector) groups with fewer members become (level, GENERIC), together with one that is there already."""
    n = F.count("*").over(Window.partitionBy("level", "sector"))
    return members.withColumn("sector", F.when(n < least, F.lit("GENERIC")).otherwise(F.col("sector")))


def feature_union(members: DataFrame) -> DataFrame:
    """The features of each bucket's members (bucket, symbol, features: array), each once, in order of the first symbol and place that has it."""
    placed = members.select("bucket", "symbol", F.posexplode("features").alias("place", "feature"))
    first = placed.groupBy("bucket", "feature").agg(F.min(F.struct("symbol", "place")).alias("at"))
    return first.groupBy("bucket").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "feature"))), lambda x: x["feature"]).alias("features"))
