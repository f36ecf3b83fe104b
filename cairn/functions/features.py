"""Feature pipeline transforms (survey F1-F12) as DataFrame estimators.

Fitting never pulls rows to the driver: every statistic is one distributed
aggregate; what a fitted model keeps on the driver is per-column constants
(means, deviations, flags). Per-value tables (id maps, category shares)
stay DataFrames and are applied with joins.
"""

from __future__ import annotations

import math
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.ids import dense_index
from cairn.functions.scalars import date_features
from cairn.operators.term_lists import tfidf_lists
from cairn.session import stored


# --------------------------------------------------------------------- F1

class FeatureId:
    """numeric id per value of ``input_col`` by descending frequency
    (ties by value), only values seen at least ``min_size`` times, at most
    ``max_classes`` ids, 1-based unless ``zero_based``. Unknown values map
    to -1, or the row is dropped with ``exclude_missing``."""

    def __init__(self, input_col: str, output_col: str, min_size: int = 0, max_classes: int = 1000,
                 exclude_missing: bool = False, zero_based: bool = False):
        self.input_col, self.output_col = input_col, output_col
        self.min_size, self.max_classes = min_size, max_classes
        self.exclude_missing, self.zero_based = exclude_missing, zero_based
        self.ids: DataFrame | None = None

    def fit(self, df: DataFrame) -> "FeatureId":
        counts = df.filter(F.col(self.input_col).isNotNull()).groupBy(self.input_col).agg(F.count(F.lit(1)).alias("_n"))
        counts = counts.filter(F.col("_n") >= self.min_size)
        # bounded by max_classes: per-task top-n then one small numbering
        top = counts.orderBy(F.desc("_n"), F.asc(self.input_col)).limit(self.max_classes)
        base = 0 if self.zero_based else 1
        self.ids = top.withColumn(self.output_col, (F.row_number().over(
            Window.orderBy(F.desc("_n"), F.asc(self.input_col))) - 1 + base).cast("int")).drop("_n")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.join(F.broadcast(self.ids), self.input_col, "left")  # <= max_classes rows
        if self.exclude_missing:
            return out.filter(F.col(self.output_col).isNotNull())
        return out.withColumn(self.output_col, F.coalesce(F.col(self.output_col), F.lit(-1)))


# --------------------------------------------------------------------- F2

def svmlight_features(df: DataFrame, key: str, features: Sequence[str], out: str = "svm") -> tuple[DataFrame, DataFrame]:
    """every (feature, value) pair gets an id (dense rank of
    "feature_value" for strings and list elements, of the feature name for
    numbers and map keys); rows become "id:value" pairs sorted by id.
    Returns (rows with the line, id table)."""
    parts = []
    schema = {f.name: f.dataType for f in df.schema.fields}
    for c in features:
        t = schema[c]
        if isinstance(t, T.ArrayType):
            parts.append(df.select(key, F.explode(c).alias("_v"))
                         .select(key, F.concat(F.lit(c + "_"), F.col("_v").cast("string")).alias("_name"), F.lit(1.0).alias("_val")))
        elif isinstance(t, T.MapType):
            parts.append(df.select(key, F.explode(c).alias("_k", "_v"))
                         .select(key, F.concat(F.lit(c + "_"), F.col("_k")).alias("_name"), F.col("_v").cast("double").alias("_val")))
        elif isinstance(t, T.NumericType):
            parts.append(df.filter(F.col(c).isNotNull()).select(key, F.lit(c).alias("_name"), F.col(c).cast("double").alias("_val")))
        else:
            parts.append(df.filter(F.col(c).isNotNull())
                         .select(key, F.concat(F.lit(c + "_"), F.col(c).cast("string")).alias("_name"), F.lit(1.0).alias("_val")))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    names = long.select("_name").distinct()
    ids = dense_index(names, ["_name"], "feature_id").withColumn("feature_id", F.col("feature_id").cast("int"))
    j = long.join(ids, "_name")
    rows = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("feature_id", "_val"))).alias("_p")) \
        .select(key, F.concat_ws(" ", F.transform("_p", lambda x: F.concat(
            x["feature_id"].cast("string"), F.lit(":"), F.format_string("%.6f", x["_val"])))).alias(out))
    return rows, ids.withColumnRenamed("_name", "feature")


# --------------------------------------------------------------------- F3

def tokenize(col, pattern: str = r"[^\p{L}\p{N}]+") -> Column:
    """Lower-case word tokens (letters/digits), empties removed."""
    return F.filter(F.split(F.lower(col), pattern), lambda x: x != "")


def tfidf(docs: DataFrame, key: str, tokens: str, min_df: int = 1, max_df: float = 1.0,
          stop_words: Sequence[str] = (), lists: bool = False):
    """term counts -> smoothed idf ln((1 + n) / (1 + df)) + 1 -> L2
    normalised tf-idf per document, as (key, term, weight). Terms in fewer
    than ``min_df`` documents or in more than ``max_df`` of them are dropped.

    Where the caller has dealt the documents by their key, as texts, counts, weights and norms are
    made where the document is. The idf table is stored first, so that a vocabulary small
    enough to broadcast does not deal the documents' terms again. With ``lists`` the weights come as ``TermLists``, a row a
    document, and documents are only dealt if a key comes twice."""
    if lists:
        return tfidf_lists(docs, key, tokens, min_df, max_df, stop_words)
    terms = docs.select(key, F.explode(tokens).alias("term"))
    if stop_words:
        terms = terms.filter(~F.col("term").isin(list(stop_words)))
    tf = terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    n = docs.agg(F.count(F.lit(1))).scalar()
    df_ = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df_ = df_.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n))
    idf = stored(df_.select("term", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf")), "idf")
    w = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("_norm")).alias("weight"))


def chi2_select(weights: DataFrame, labels: DataFrame, key: str, label: str, top_n: int) -> DataFrame:
    """F3 selection: chi-squared score of each term, with observed o_c = the
    term's weight summed over documents of class c, t = sum over classes and
    expected t * p_c (p_c = class share). Since sum o_c = t and sum p_c = 1,
    chi2 = sum_c o_c^2 / (t p_c) - t needs only the observed (term, class)
    pairs. The ``top_n`` best terms."""
    j = weights.join(labels.select(key, label), key)
    obs = j.groupBy("term", label).agg(F.sum("weight").alias("o"))
    nl = labels.agg(F.count(F.lit(1))).scalar()
    prior = labels.groupBy(label).agg((F.count(F.lit(1)) / nl).alias("p"))
    s = obs.join(prior, label).groupBy("term").agg(
        F.sum(F.col("o") * F.col("o") / F.col("p")).alias("_q"), F.sum("o").alias("_t"))
    score = s.select("term", (F.col("_q") / F.col("_t") - F.col("_t")).alias("chi2"))
    # rank on the score rounded to 9 decimals so float noise cannot reorder ties
    return score.orderBy(F.desc(F.round("chi2", 9)), F.asc("term")).limit(top_n)


# --------------------------------------------------------------------- F6 / F7

# Strings read as booleans by the automatic transform.
BOOL_MAP = {"true": 1, "false": 0, "1": 1, "0": 0, "yes": 1, "no": 0, "1.0": 1, "0.0": 0}


class AutoTransform:
    """column profiling and automatic transforms.

    fit: one wide aggregate gives per column the non-null count, the number
    of distinct values, min/max/mean/population stddev for numbers and an
    order-independent fingerprint used to find duplicate columns; value
    shares of categorical columns come from one grouped count over a long
    (column, value) view. transform: booleans mapped, numbers clamped and
    standardised (null -> 0), categories lower-cased (numbers prefixed with
    the column name), out-of-range shares -> null, missing -> ``UKN``,
    dates expanded to cyclic features."""

    def __init__(self, exclude: Sequence[str] = (), date_cols: Sequence[str] = (), min_cat_percent: float = 0.0,
                 max_cat_percent: float = 1.0, max_values_numeric_categorical: int = 0,
                 nan_threshold: float | None = None, drop_constant: bool = True, drop_duplicates: bool = True,
                 min_max_limit: bool = False, ignore_vals: Sequence[str] = (), cat_missing: str = "UKN",
                 bool_map: Mapping[str, int] = BOOL_MAP):
        self.exclude, self.date_cols = set(exclude), list(date_cols)
        self.min_cat, self.max_cat = min_cat_percent, max_cat_percent
        self.max_num_cat = max_values_numeric_categorical
        self.nan_threshold, self.drop_constant, self.drop_duplicates = nan_threshold, drop_constant, drop_duplicates
        self.min_max_limit, self.ignore_vals, self.cat_missing = min_max_limit, list(ignore_vals), cat_missing
        self.bool_map = dict(bool_map)

    def _clean(self, df: DataFrame, c: str) -> Column:
        v = F.col(c)
        if isinstance(df.schema[c].dataType, T.StringType):
            v = F.when(F.col(c) == "", None).otherwise(F.col(c))
        if self.ignore_vals:
            v = F.when(v.cast("string").isin(self.ignore_vals), None).otherwise(v)
        return v

    def fit(self, df: DataFrame) -> "AutoTransform":
        cols = [c for c in df.columns if c not in self.exclude]
        types = {f.name: f.dataType for f in df.schema.fields}
        numeric = {c for c in cols if isinstance(types[c], T.NumericType)}
        dates = {c for c in cols if isinstance(types[c], (T.TimestampType, T.TimestampNTZType, T.DateType))} | set(self.date_cols)
        clean = df.select(*[self._clean(df, c).alias(c) for c in cols])
        row_h = F.xxhash64(*[F.col(c).cast("string") for c in cols])
        aggs = [F.count(F.lit(1)).alias("__n")]
        for i, c in enumerate(cols):
            aggs += [F.count(c).alias(f"nn{i}"), F.approx_count_distinct(c).alias(f"nd{i}"),
                     F.min(F.col(c).cast("string")).alias(f"lo{i}"), F.max(F.col(c).cast("string")).alias(f"hi{i}"),
                     F.sum(F.xxhash64(row_h, F.col(c).cast("string")) % 1000003).alias(f"fp{i}"),
                     F.max(F.lower(F.col(c).cast("string")).isin(list(self.bool_map)) == F.lit(False)).alias(f"nb{i}")]
            if c in numeric:
                aggs += [F.min(c).alias(f"mn{i}"), F.max(c).alias(f"mx{i}"), F.avg(c).alias(f"mu{i}"),
                         F.stddev_pop(c).alias(f"sd{i}")]
        prof = clean.agg(*aggs).first().asDict()  # one row of per-column constants
        n = prof["__n"]
        self.drop, self.bools, self.nums, self.cats, self.dates = [], [], {}, [], []
        seen_fp = {}
        for i, c in enumerate(cols):
            key = (str(types[c]), prof[f"fp{i}"], prof[f"nn{i}"])
            if self.drop_duplicates and key in seen_fp:
                self.drop.append(c)
                continue
            seen_fp[key] = c
            if self.nan_threshold is not None and n - prof[f"nn{i}"] > n * self.nan_threshold:
                self.drop.append(c)
                continue
            distinct = prof[f"nd{i}"] + (1 if prof[f"nn{i}"] < n else 0)
            constant = (prof[f"nn{i}"] == 0) or (prof[f"nn{i}"] == n and prof[f"lo{i}"] == prof[f"hi{i}"])
            if self.drop_constant and constant:
                self.drop.append(c)
                continue
            all_bool = not prof[f"nb{i}"] and prof[f"nn{i}"] == n
            if all_bool:
                self.bools.append(c)
            elif c in numeric and c not in dates:
                if distinct > self.max_num_cat:
                    self.nums[c] = (prof[f"mn{i}"], prof[f"mx{i}"], prof[f"mu{i}"], prof[f"sd{i}"])
                else:
                    self.cats.append(c)
            elif c in dates:
                self.dates.append(c)
            else:
                self.cats.append(c)
        if self.cats:
            long = clean.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value"))
                                                    for c in self.cats])).alias("kv")).select("kv.col", "kv.value")
            shares = long.groupBy("col", "value").agg((F.count(F.lit(1)) / F.lit(float(n))).alias("share"))
            self.cat_values = shares.filter(F.col("value").isNotNull() & (F.col("share") >= self.min_cat) &
                                            (F.col("share") <= self.max_cat)).select("col", "value")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.drop(*self.drop)
        keep = [c for c in out.columns]
        sel = []
        for c in keep:
            if c in self.exclude:
                sel.append(F.col(c))
            elif c in self.bools:
                m = F.create_map(*[x for k, v in self.bool_map.items() for x in (F.lit(k), F.lit(v))])
                sel.append(m[F.lower(F.col(c).cast("string"))].alias(c))
            elif c in self.nums:
                mn, mx, mu, sd = self.nums[c]
                v = self._clean(df, c).cast("double")
                if self.min_max_limit:
                    v = F.least(F.greatest(v, F.lit(float(mn))), F.lit(float(mx)))
                z = (v - F.lit(float(mu))) / F.lit(float(sd) if sd else 1.0)
                sel.append(F.coalesce(z, F.lit(0.0)).alias(c))
            elif c in self.dates:
                sel += date_features(F.col(c), c, ("h", "m", "w", "y"))
            elif c in self.cats:
                sel.append(self._clean(df, c).cast("string").alias(c))
            else:
                sel.append(F.col(c))
        res = out.select(*sel)
        numeric_cats = {c for c in self.cats if isinstance(df.schema[c].dataType, T.NumericType)}
        for c in self.cats:
            ok = self.cat_values.filter(F.col("col") == c).select(F.col("value").alias(c), F.lit(True).alias("_ok"))
            res = res.join(ok, c, "left")
            val = F.regexp_replace(F.lower(F.col(c)), " ", "_")
            if c in numeric_cats:
                val = F.concat(F.lit(c + "_"), val)
            res = res.withColumn(c, F.when(F.col(c).isNull(), F.lit(self.cat_missing))
                                 .when(F.col("_ok"), val).otherwise(F.lit(None).cast("string"))).drop("_ok")
        return res


# --------------------------------------------------------------------- F8 / F9 / F10 / F11

def standard_scale(df: DataFrame, cols: Sequence[str], prefix: str = "scaled_") -> DataFrame:
    """F8: Spark ML StandardScaler (mean and sample deviation) on numeric
    columns; outputs back to named double columns."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    va = VectorAssembler(inputCols=list(cols), outputCol="_vec", handleInvalid="keep")
    v = va.transform(df)
    model = StandardScaler(inputCol="_vec", outputCol="_sc", withMean=True, withStd=True).fit(v)
    s = model.transform(v).withColumn("_arr", vector_to_array("_sc"))
    return s.select(*df.columns, *[F.col("_arr")[i].alias(prefix + c) for i, c in enumerate(cols)])


def assemble(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], out: str = "features") -> DataFrame:
    """numeric columns (null -> 0) plus one-hot categoricals in one vector."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    idx = [StringIndexer(inputCol=c, outputCol=c + "_idx", handleInvalid="keep", stringOrderType="alphabetAsc")
           for c in categorical]
    ohe = OneHotEncoder(inputCols=[c + "_idx" for c in categorical], outputCols=[c + "_ohe" for c in categorical])
    va = VectorAssembler(inputCols=list(numeric) + [c + "_ohe" for c in categorical], outputCol=out)
    filled = df.fillna(0, subset=list(numeric))
    return Pipeline(stages=idx + [ohe, va]).fit(filled).transform(filled)


def text_pipeline(text_col: str = "text", features: str = "features", num_features: int = 1 << 16):
    """tokenizer -> hashing tf -> idf -> standard scaling, as a Spark ML pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, StandardScaler
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_idf"),
        StandardScaler(inputCol="_idf", outputCol=features, withMean=False, withStd=True)])


def save_pipeline(model, path: str) -> None:
    """persist a fitted pipeline (path on shared storage)."""
    model.write().overwrite().save(path)


def load_pipeline(path: str):
    """load a persisted pipeline model."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


# --------------------------------------------------------------------- F5 / F12

def vw_lines(events: DataFrame, json_col: str, target: str, exclude: Sequence[str] = (), oaa: bool = True,
             key: str = "event_id") -> DataFrame:
    """one VW line per JSON event: "<label> |f k:v ..." with numeric
    fields as name:value and other fields as name_value (sorted by name);
    label = class id of the target (1-based with one-against-all, else +1/-1)."""
    m = F.from_json(F.col(json_col), "map<string,string>")
    ex = events.select(key, target, F.explode(m).alias("k", "v")).filter(~F.col("k").isin(list(exclude)))
    num = F.col("v").try_cast("double")
    tok = F.when(num.isNotNull(), F.concat(F.col("k"), F.lit(":"), F.col("v"))) \
        .otherwise(F.concat(F.col("k"), F.lit("_"), F.regexp_replace(F.col("v"), r"[\s:|]", "_")))
    feats = ex.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", tok.alias("t")))).alias("_f"))
    classes = events.select(target).distinct()
    cid = classes.withColumn("_cid", F.dense_rank().over(Window.orderBy(target)))  # bounded by the class count
    lab = events.select(key, target).join(F.broadcast(cid), target)
    label = F.col("_cid").cast("string") if oaa else F.when(F.col("_cid") == 1, "1").otherwise("-1")
    return lab.join(feats, key).select(key, F.concat(label, F.lit(" |f "),
                                                     F.concat_ws(" ", F.transform("_f", lambda x: x["t"]))).alias("line"))


def tag_feature_lines(actions: DataFrame, item_tags: DataFrame, affinity: DataFrame,
                      user="user_id", item="item_id") -> DataFrame:
    """"1 |i <item tags> |u <tag>:<weight> ..." for each (user, item)
    acted on, user tags from the affinity table (sorted by tag)."""
    ua = affinity.groupBy(user).agg(F.array_sort(F.collect_list(F.struct("tag", "affinity"))).alias("_a"))
    ut = ua.select(user, F.concat_ws(" ", F.transform("_a", lambda x: F.concat(
        x["tag"], F.lit(":"), F.format_string("%.4f", x["affinity"])))).alias("_u"))
    it = item_tags.select(item, F.concat_ws(" ", F.array_sort(F.split("tags", ","))).alias("_i"))
    pairs = actions.select(user, item).distinct()
    return pairs.join(ut, user).join(it, item).select(
        user, item, F.concat(F.lit("1 |i "), F.col("_i"), F.lit(" |u "), F.col("_u")).alias("line"))


def cyclic(col, period: float) -> tuple[Column, Column]:
    ang = F.lit(2 * math.pi) * col / F.lit(period)
    return F.sin(ang), F.cos(ang)


def history_tfidf_lines(lines: DataFrame, keys: Sequence[str], line: str = "line", min_doc_freq: int = 1,
                        max_user_features: int = 10) -> tuple[DataFrame, DataFrame]:
    """tf-idf over the feature lines of W5/W6 (exact terms): idf =
    ln((m + 1) / (df + 1)) with m lines, 0 below ``min_doc_freq``; output
    "1 |i <i_f:w ...> |u <u_f:w ...>" with item features in line order and at
    most max_user_features + 1 user features in ascending tf-idf (ties by
    name). Returns (lines, idf table)."""
    keys = list(keys)
    tok = lines.select(*keys, F.posexplode(F.split(line, " ")).alias("pos", "term")).filter(F.col("term") != "")
    tf = tok.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("pos"))
    m = lines.agg(F.count(F.lit(1))).scalar()
    dfq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = dfq.select("term", F.when(F.col("df") >= min_doc_freq, F.log((m + F.lit(1.0)) / (F.col("df") + 1.0)))
                     .otherwise(F.lit(0.0)).alias("idf"))
    w = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    fmt = lambda x: F.concat(x["term"], F.lit(":"), F.format_string("%.6f", x["w"]))
    g = w.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("term").startswith("i_"), F.struct("pos", "term", "w")))).alias("_i"),
        F.array_sort(F.collect_list(F.when(F.col("term").startswith("u_"), F.struct("w", "term")))).alias("_u"))
    out = g.select(*keys, F.concat(F.lit("1 |i "), F.concat_ws(" ", F.transform("_i", fmt)), F.lit(" |u "),
                                   F.concat_ws(" ", F.transform(F.slice("_u", 1, max_user_features + 1), fmt))).alias("features"))
    return out, idf
