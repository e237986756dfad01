"""Feature sets, grouped splits, boosted regression and scoring of confidence models.

Channel families follow the column name: ``__`` marks neighbourhood aggregates (D); mean_knn_dist* and roughness* are geometry
(E); two fixed sets are sensor (A) and within-scan (B) channels; every other channel is SLAM-internal (C).
"""

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointspark.functions.missing import finite

#: Channels by family, and columns that are labels or ids and never features.
FAMILY_A = ("intensity", "reflectivity", "ambient", "ring", "scan_time", "range")
FAMILY_B = ("range_detach", "range_edge", "int_detach", "ring_rough")
NEVER = (
    "point_id", "scan_id", "cloud_id", "scene", "x", "y", "z", "rgb", "cell_id", "voxel_id", "leaf_id", "C2C_distance", "c2c_rigid", "domain_code", "eval_domain", "visibility_code",
    "gt_group", "stretch_id", "splitx_block", "splitx_ok", "labelled_at", "predicted_c2c", "filter_keep",
)
ALIASES = {"intensity_orig": "intensity"}
MAX_FIT_ROWS = 500_000


def family(name: str) -> str:
    if "__" in name:
        return "D"
    if name.startswith(("mean_knn_dist", "roughness")):
        return "E"
    return "A" if name in FAMILY_A else "B" if name in FAMILY_B else "C"


def base_channel(name: str) -> str:
    head = name.split("__")[0]
    return ALIASES.get(head, head)


def discover(df: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Aliases renamed, features only besides the key columns; a wanted channel that is absent is an error."""
    out = df
    for old, new in ALIASES.items():
        if old in out.columns and new not in out.columns:
            out = out.withColumnRenamed(old, new)
    if wanted:
        missing = sorted(set(wanted) - set(out.columns))
        if missing:
            raise ValueError(f"no such channels: {missing}; there are {sorted(out.columns)}")
    return out


def features_of(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in NEVER and f.dataType.typeName() in ("float", "double", "integer", "long", "byte", "short") and not f.name.endswith("__nofit")]


def default_aggregated(columns: list[str]) -> list[str]:
    """Channels that family D is computed for."""
    return [c for c in columns if c not in NEVER and "__" not in c and family(c) != "E"]


def drop_columns(df: DataFrame, names: list[str], aggregates: bool = False) -> DataFrame:
    """Drops named columns and, if asked, all aggregates; an unknown name is an error."""
    unknown = sorted(set(names) - set(df.columns))
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    return df.drop(*names, *[c for c in df.columns if aggregates and "__" in c])


def exclude(columns: list[str], raw: list[str], keep: tuple[str, ...] = ()) -> list[str]:
    """Without the raw channels and everything derived from them, unless kept (P5)."""
    return [c for c in columns if c in keep or base_channel(c) not in raw]


def shared_channels(frames: list[DataFrame]) -> tuple[list[str], list[str]]:
    """Channels of all frames in first-seen order, and those that pooling drops."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    seen = dict.fromkeys(c for f in frames for c in f.columns)
    return common, [c for c in seen if c not in common]


def pool(frames: dict[str, DataFrame], distance: str = "C2C_distance") -> DataFrame:
    """In-domain rows of several scenes with their common channels and a scene tag."""
    named = {k: discover(f) for k, f in frames.items()}
    common, _ = shared_channels(list(named.values()))
    out = None
    for k, f in named.items():
        part = in_domain(f, distance).select(*[c for c in common if c != "scene"], F.lit(k).alias("scene"))
        out = part if out is None else out.unionByName(part)
    return out


def pool_sample(frames: dict[str, DataFrame], key: str, rows: int, distance: str = "C2C_distance", seed: int = 42) -> DataFrame:
    """pool, thinned to about ``rows`` rows: usable rows are counted first, then each is kept with the share that is wanted."""
    from pointspark.operators.stats import hash_sample

    return hash_sample(pool(frames, distance), ["scene", key], rows, seed)


def in_domain(df: DataFrame, distance: str = "C2C_distance", flag: str = "eval_domain") -> DataFrame:
    """Rows with a distance inside the evaluation domain."""
    ok = finite(distance) >= 0
    return df.where(ok & F.col(flag)) if flag in df.columns else df.where(ok)


def group_key(group: Column, scene: Column, item: Column) -> Column:
    """Group id unique over scenes; unassigned rows are groups of their own."""
    return F.when(group.isNull() | (group < 0), F.concat_ws("|", F.lit("lone"), item.cast("string"))).otherwise(F.concat_ws("|", scene, group.cast("string")))


def duplicate_channels(df: DataFrame, channels: list[str]) -> list[tuple[str, str]]:
    """(kept, duplicate) channels that agree bit for bit in every row (P19), found in one pass by equal fingerprints."""
    prints = df.withColumn("_at", F.monotonically_increasing_id()).agg(*[F.sum(F.xxhash64(F.col(c).cast("double"), "_at").cast("decimal(38,0)")).alias(c) for c in channels]).first()
    first: dict = {}
    out = []
    for c in channels:
        if prints[c] in first:
            out.append((first[prints[c]], c))
        else:
            first[prints[c]] = c
    return out


def arms(columns: list[str]) -> dict[str, list[str]]:
    """Column sets of the standard comparisons."""
    of = lambda fams: [c for c in columns if family(c) in fams]
    out = {"geom_only": of("E"), "slam_int_only": of("C"), "sensor_only": of("A"), "slam_only": of("ABC"), "slam_agg": of("ABCD"), "slam_plus": of("ABCDE")}
    out |= {f"geom_plus_{x}": of("E" + x) for x in "ABCD"}
    return out | {f"no_{x}": of(set("ABCDE") - {x}) for x in "ABCDE"} | {f"no_{x}_all": [c for c in of(set("ABCDE") - {x}) if family(base_channel(c)) != x] for x in "ABC"}


def top_arms(importance: dict[str, float], counts: tuple[int, ...] = (3, 5, 10), geometry: list[str] | None = None) -> dict[str, list[str]]:
    """Column sets of the n most important features, alone and beside the geometric ones; each is fitted anew."""
    out = {f"top{n}": top_features(importance, n) for n in counts}
    return out | {f"geomplus{n}": [*(geometry or []), *[c for c in top_features(importance, n) if c not in (geometry or [])]] for n in counts}


def group_choice(scenes: int, has_group: bool, mode: str = "auto") -> str:
    """How validation rows are held out: by scene only with more than two scenes, else by group, else at random."""
    if mode != "auto":
        return mode
    return "scene" if scenes > 2 else "group" if has_group else "random"


def holdout_scenes(names: list[str], wanted: list[str]) -> list[str]:
    """Scenes by name or unique suffix (U4)."""
    out = []
    for w in wanted:
        hit = [n for n in names if n == w] or [n for n in names if n.endswith(w)]
        if len(hit) != 1:
            raise ValueError(f"{w!r} names {len(hit)} scenes")
        out += hit
    return out


def split_groups(df: DataFrame, group: Column, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``validation``: whole groups by the hash of their key."""
    return df.withColumn("validation", F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(1000)) < int(share * 1000))


class Booster:
    """Histogram gradient boosting for squared error or a quantile; missing values go to the better side.

    Fitted on the driver on a bounded, documented sample (at most MAX_FIT_ROWS rows); scoring is distributed.
    """

    def __init__(self, objective: str = "mean", quantile: float = 0.9, rate: float = 0.1, most: int = 300, leaves: int = 15, bins: int = 64, least: int = 20, step: int = 10, patience: int = 3) -> None:
        self.objective, self.quantile, self.rate, self.most = objective, quantile, rate, most
        self.leaves, self.bins, self.least, self.step, self.patience = leaves, bins, least, step, patience
        self.trees: list[list[tuple]] = []

    def _residual(self, y: np.ndarray, p: np.ndarray) -> np.ndarray:
        return y - p if self.objective == "mean" else np.where(y > p, self.quantile, self.quantile - 1)

    def _leaf(self, y: np.ndarray, p: np.ndarray) -> float:
        return float(np.mean(y - p)) if self.objective == "mean" else float(np.quantile(y - p, self.quantile))

    def loss(self, y: np.ndarray, p: np.ndarray) -> float:
        d = y - p
        return float(np.mean(d * d)) if self.objective == "mean" else float(np.mean(np.maximum(self.quantile * d, (self.quantile - 1) * d)))

    def _code(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, dtype=np.int16)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), -1, np.searchsorted(e, x[:, j], side="right"))
        return out

    def _split(self, code: np.ndarray, g: np.ndarray, rows: np.ndarray):
        best = None
        total, n = g[rows].sum(), len(rows)
        for j in range(code.shape[1]):
            c = code[rows, j]
            s = np.bincount(c + 1, weights=g[rows], minlength=self.bins + 2)
            m = np.bincount(c + 1, minlength=self.bins + 2)
            for left in (True, False):
                sl, ml = np.cumsum(s[1:])[:-1] + s[0] * left, np.cumsum(m[1:])[:-1] + m[0] * left
                ok = (ml >= self.least) & (n - ml >= self.least)
                gain = np.where(ok, sl**2 / np.maximum(ml, 1) + (total - sl) ** 2 / np.maximum(n - ml, 1), -np.inf)
                k = int(gain.argmax())
                if ok[k] and (best is None or gain[k] > best[0]):
                    best = (gain[k], j, k, left)
        return None if best is None or best[0] <= total**2 / n + 1e-12 else best

    def _grow(self, code: np.ndarray, y: np.ndarray, p: np.ndarray) -> list[tuple]:
        g = self._residual(y, p)
        nodes: list = [None]
        open_ = [(0, np.arange(len(y)))]
        found = [self._split(code, g, open_[0][1])]
        while len(open_) < self.leaves and any(f is not None for f in found):
            i = max((i for i, f in enumerate(found) if f is not None), key=lambda i: found[i][0] - g[open_[i][1]].sum() ** 2 / len(open_[i][1]))
            (node, rows), (_, j, k, left) = open_.pop(i), found.pop(i)
            c = code[rows, j]
            go = np.where(c < 0, left, c <= k)
            nodes[node] = (j, k, left, len(nodes), len(nodes) + 1)
            for part in (rows[go], rows[~go]):
                open_.append((len(nodes), part))
                nodes.append(None)
                found.append(self._split(code, g, part))
        for node, rows in open_:
            nodes[node] = (self.rate * self._leaf(y[rows], p[rows]),)
        return nodes

    @staticmethod
    def _apply(nodes: list[tuple], code: np.ndarray) -> np.ndarray:
        at, out = np.zeros(len(code), dtype=np.int64), np.zeros(len(code))
        for i, n in enumerate(nodes):
            rows = np.flatnonzero(at == i)
            if len(n) == 1:
                out[rows] = n[0]
            else:
                c = code[rows, n[0]]
                at[rows] = np.where(np.where(c < 0, n[2], c <= n[1]), n[3], n[4])
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, vx: np.ndarray | None = None, vy: np.ndarray | None = None) -> "Booster":
        self.edges = [np.unique(np.quantile(c[~np.isnan(c)], np.linspace(0, 1, self.bins)[1:-1])) if (~np.isnan(c)).any() else np.zeros(0) for c in x.T]
        code, self.start = self._code(x), float(np.mean(y) if self.objective == "mean" else np.quantile(y, self.quantile))
        p = np.full(len(y), self.start)
        held = vy is not None and len(vy) > 0
        vcode, vp = (self._code(vx), np.full(len(vy), self.start)) if held else (None, None)
        best, keep, waits = np.inf, 0, 0
        for t in range(self.most):
            tree = self._grow(code, y, p)
            self.trees.append(tree)
            p += self._apply(tree, code)
            if held:
                vp += self._apply(tree, vcode)
                if (t + 1) % self.step == 0:
                    now = self.loss(vy, vp)
                    best, keep, waits = (now, t + 1, 0) if now < best else (best, keep, waits + 1)
                    if waits >= self.patience:
                        break
        if held and keep:
            self.trees = self.trees[:keep]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        code = self._code(x)
        return self.start + sum((self._apply(t, code) for t in self.trees), np.zeros(len(x)))

    def to_json(self, features: list[str]) -> str:
        return json.dumps({"objective": self.objective, "quantile": self.quantile, "rate": self.rate, "bins": self.bins, "start": self.start, "features": features, "edges": [e.tolist() for e in self.edges], "trees": self.trees})

    @classmethod
    def from_json(cls, text: str) -> tuple["Booster", list[str]]:
        d = json.loads(text)
        b = cls(d["objective"], d["quantile"], d["rate"], bins=d["bins"])
        b.start, b.edges, b.trees = d["start"], [np.array(e) for e in d["edges"]], [[tuple(n) for n in t] for t in d["trees"]]
        return b, d["features"]


def training_sample(df: DataFrame, features: list[str], target: str, key: str, rows: int = MAX_FIT_ROWS, seed: int = 42):
    """(x, y, validation) of at most ``rows`` rows: those of the smallest hashes of the key, the same in any partitioning."""
    n = max(df.count(), 1)
    parts = 1 << 30
    share = min(1.0, 1.05 * rows / n + 1000 / n)  # a hash threshold first, so that only about ``rows`` rows are ordered
    part = df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(parts)) < int(share * parts)).orderBy(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(parts)), key).limit(rows)
    pdf = part.orderBy(key).select(*[finite(c).alias(c) for c in features], finite(target).alias("_y"), "validation").toPandas()
    return pdf[features].to_numpy(dtype=float), pdf["_y"].to_numpy(dtype=float), pdf["validation"].to_numpy(dtype=bool)


def fit(df: DataFrame, features: list[str], target: str, key: str, objective: str = "mean", **options) -> Booster:
    """Boosted regression with whole groups held out for early stopping (U1, U2); needs a ``validation`` column.

    The held-out groups only choose the number of rounds; the model is then fitted anew with it on all rows of the sample.
    """
    x, y, v = training_sample(df, features, target, key)
    chosen = Booster(objective, **options).fit(x[~v], y[~v], x[v], y[v])
    return Booster(objective, **{**options, "most": len(chosen.trees)}).fit(x, y) if v.any() else chosen


def score(df: DataFrame, models: dict[str, tuple[Booster, list[str]]]) -> DataFrame:
    """Adds one column a model in a single pass over the cloud (U7); rows keep their other columns."""
    names = list(models)
    used = sorted({f for _, fs in models.values() for f in fs})
    held = df.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
    def predict(values: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({n: b.predict(values[fs].to_numpy(dtype=float)) for n, (b, fs) in held.value.items()})

    out = df.withColumn("_p", predict(F.struct(*[finite(c).alias(c) for c in used])))
    return out.withColumns({n: F.col("_p")[n] for n in names}).drop("_p")


def permutation_importance(model: Booster, features: list[str], x: np.ndarray, y: np.ndarray, groups: dict[str, list[str]] | None = None, repeats: int = 3, seed: int = 0) -> dict[str, float]:
    """Rise of the mean absolute error when a feature, or all of a bucket by one permutation, is shuffled."""
    rng, base, out = np.random.default_rng(seed), np.mean(np.abs(y - model.predict(x))), {}
    for name, cols in (groups or {f: [f] for f in features}).items():
        at = [features.index(c) for c in cols]
        rise = []
        for _ in range(repeats):
            z, order = x.copy(), rng.permutation(len(x))
            z[:, at] = x[order][:, at]
            rise.append(np.mean(np.abs(y - model.predict(z))) - base)
        out[name] = float(np.mean(rise))
    return out


def importance_buckets(features: list[str], folded: bool = False) -> dict[str, list[str]]:
    """Features by family; folded puts aggregates to the family of the channel they come from."""
    out: dict[str, list[str]] = {}
    for f in features:
        out.setdefault(family(base_channel(f)) if folded else family(f), []).append(f)
    return out


def top_features(importance: dict[str, float], n: int) -> list[str]:
    """T3."""
    return [k for k, _ in sorted(importance.items(), key=lambda kv: (-kv[1], kv[0]))[:n]]


def save(path: str, model: Booster, features: list[str], recipe: dict) -> None:
    """Model bundle on shared storage: model, features, recipe (U8)."""
    from pointspark.sources import storage

    storage.write_whole(f"{path}/model.json", [model.to_json(features).encode()])
    storage.write_whole(f"{path}/recipe.json", [json.dumps(recipe).encode()])


def load(path: str) -> tuple[Booster, list[str], dict]:
    from pointspark.sources import storage

    texts = []
    for name in ("model.json", "recipe.json"):
        with storage.reader(f"{path}/{name}") as f:
            texts.append(f.read().decode())
    model, features = Booster.from_json(texts[0])
    return model, features, json.loads(texts[1])
