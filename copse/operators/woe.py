"""Weight-of-evidence encoding of categorical columns (our own textbook formula, smoothing 0.5).

woe = ln(((pos_c + a) / (pos + a C)) / ((neg_c + a) / (neg + a C))), C the
number of categories of the feature; categories not seen at fit encode as 0.
Multiclass targets are encoded one against the rest; a continuous target is
cut at its median first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copse.sources.frames import free_name, materialised, with_rank

SMOOTHING = 0.5


def woe_table(df: DataFrame, cats: list[str], positive, a: float = SMOOTHING) -> DataFrame:
    """(feature, category, pos, neg, woe) for a boolean column expression; rows with a null category are their own category."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("category")) for i, c in enumerate(cats)])).alias("c")
    long = df.select(positive.cast("long").alias("p"), cells).select("p", "c.*")
    t = long.groupBy("feature", "category").agg(F.sum("p").alias("pos"), (F.count("*") - F.sum("p")).alias("neg"))
    w = Window.partitionBy("feature")  # a row per category
    k = F.count("*").over(w)
    pos = (F.col("pos") + a) / (F.sum("pos").over(w) + a * k)
    neg = (F.col("neg") + a) / (F.sum("neg").over(w) + a * k)
    return t.select("feature", "category", "pos", "neg", F.log(pos / neg).alias("woe"))


def information_value(table: DataFrame) -> DataFrame:
    """(feature, iv): sum of (share of positives - share of negatives) x woe."""
    w = Window.partitionBy("feature")
    t = table.select("feature", (F.col("pos") / F.sum("pos").over(w) - F.col("neg") / F.sum("neg").over(w)).alias("d"), "woe")
    return t.groupBy("feature").agg(F.sum(F.col("d") * F.col("woe")).alias("iv"))


def median_split(df: DataFrame, target: str):
    """y > median(y), the median of an even count being the mean of the middle two."""
    y = with_rank(df.select(F.col(target).cast("double").alias("y")).filter("y is not null"), ["y"])
    n = y.count()
    m = y.filter(F.col("rank").isin((n - 1) // 2, n // 2)).agg(F.avg("y")).first()[0]
    return F.col(target) > F.lit(m)


def task_of(df: DataFrame, target: str) -> str:
    """binary, multiclass or continuous, as the target's values say: fractions are continuous, over two whole values multiclass."""
    y = F.col(target).cast("double")
    r = df.agg(F.max((y != F.floor(y)).cast("int")).alias("parts"), F.min(y).alias("lo"), F.max(y).alias("hi")).first()
    if r["parts"]:
        return "continuous"
    return "binary" if df.filter((y != r["lo"]) & (y != r["hi"])).isEmpty() else "multiclass"


@dataclass
class WoeModel:
    cats: list[str]
    numeric: list[str]
    tables: list[DataFrame]  # one, or one per class
    n_classes: int

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep, then the encoded columns in the order of cats (by class if multiclass), then the numeric ones; one join a feature."""
        every = None
        for k, t in enumerate(self.tables):
            own = t.select("feature", "category", F.lit(k).alias("k"), "woe")
            every = own if every is None else every.unionByName(own)
        out, names = df, []
        for i, c in enumerate(self.cats):
            cat, woe = free_name(out, "cat"), free_name(out, "woe")
            own = every.filter(F.col("feature") == i).groupBy(F.col("category").alias(cat)).agg(F.map_from_entries(F.collect_list(F.struct("k", "woe"))).alias(woe))  # a class each
            out = out.join(own, F.coalesce(F.col(c).cast("string"), F.lit("null")) == F.col(cat), "left")
            for k in range(len(self.tables)):
                name = f"woe_{c}" if len(self.tables) == 1 else f"woe_{c}_{k}"
                out = out.withColumn(name, F.coalesce(F.element_at(F.col(woe), k), F.lit(0.0)))
                names.append(name)
            out = out.drop(cat, woe)
        return out.select(*keep, *names, *[F.col(c).cast("double").alias(c) for c in self.numeric])

    def to_dict(self, n_features: int, positions: dict[str, int]) -> dict:
        """Portable form: indices, and a map from category to weight per feature (per class if multiclass)."""
        maps = [[{r["category"]: r["woe"] for r in t.filter(F.col("feature") == i).collect()} for t in self.tables] for i in range(len(self.cats))]
        multi = len(self.tables) > 1
        cat = [positions[c] for c in self.cats]
        out = {"cat_features": cat, "numeric_features": [i for i in range(n_features) if i not in cat], "woe_multiclass": multi, "woe_tables": maps if multi else [m[0] for m in maps]}
        return out | ({"n_woe_classes": self.n_classes} if multi else {})


@dataclass
class WoeEncoder:
    cat_features: list[str] | None = None

    def fit(self, df: DataFrame, features: list[str], target: str, task: str | None = None) -> WoeModel:
        """task: binary, multiclass (labels 0..K-1) or continuous; told from the target where it isn't given. Tables are written once."""
        cats = list(self.cat_features or [])
        numeric = [c for c in features if c not in cats]
        y = F.col(target)
        if not cats:
            return WoeModel([], numeric, [], 0)
        task = task or task_of(df, target)
        if task == "multiclass":
            labels = [r[0] for r in df.select(y.cast("int")).distinct().orderBy(y.cast("int")).collect()]
            return WoeModel(cats, numeric, [materialised(woe_table(df, cats, y.cast("int") == k), "woe") for k in labels], len(labels))
        positive = median_split(df, target) if task == "continuous" else y.cast("int") == 1
        return WoeModel(cats, numeric, [materialised(woe_table(df, cats, positive), "woe")], 2)

    def iv(self, model: WoeModel) -> DataFrame:
        out = None
        for k, t in enumerate(model.tables):
            own = information_value(t).select(F.lit(k).alias("output"), "feature", "iv")
            out = own if out is None else out.unionByName(own)
        return out
