"""Schemas that drift between the files of a series: matching, change report and one cast and unioned table.

Each file is compared with the file before it in its series by similarity flooding over two schema graphs (schema root ->
nesting -> field -> type, and field -> next field). Pairs start with the likeness of their names and, gathered by one join over all
records, the share of shared points on which their values agree; scores are propagated to convergence, and each field
takes the partner that is best for both. Such a match is a rename if its values agree on every shared point; a match that they
refute is struck out, and the rest is flooded again until no match is left.

Defined cases: names are compared in lower case without outer blanks, a name that a header repeats counts once at its
first position; NULL, left-out and NaN values are not given; a pair without a shared given value is no rename; records
without a parsable point_idx or of an unknown file take no part in matching; values that don't fit the resolved type
become NULL; if two names of a record lead to one field, the first of them in the record counts; whole numbers are compared and
cast without a detour over doubles; empty tables give empty results; other columns of the inputs are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointspark.session import cut

#: Every file has these; they identify and place a point and take no part in the change report.
FIXED = ("point_idx", "x", "y", "z")
FLOOD_STEPS, FLOOD_EPS = 100, 1e-3
#: Weight of the edges between fields that follow each other: files shuffle them, so they tell little.
NEXT = 0.05
_NAME_TYPE = "array<struct<name:string,type:string>>"


def _line(key: str) -> Column:
    """Tokens of the PCD header line that begins with ``key``."""
    got = F.trim(F.regexp_extract("header", rf"(?im)^[ \t]*{key}[ \t]+([^\r\n]*)", 1))
    return F.when(got == "", F.array().cast("array<string>")).otherwise(F.split(got, r"\s+"))


def declared_fields(files: DataFrame) -> DataFrame:
    """(file_id, series_id, file_seq, stage, pos, name, type, nest) of every field that a header declares; nest: where in the header."""
    pcd = F.transform(F.arrays_zip(_line("FIELDS").alias("n"), _line("TYPE").alias("t"), _line("SIZE").alias("s")), lambda p: F.struct(p["n"].alias("name"), F.concat(F.upper(p["t"]), p["s"]).alias("type")))
    listed = F.from_json("header", f"extra_dims {_NAME_TYPE}")["extra_dims"]
    mapped = F.from_json("header", "extra_dims map<string,string>")["extra_dims"]
    as_json = F.coalesce(F.when(F.exists(listed, lambda e: e["name"].isNotNull()), listed), F.transform(F.map_entries(mapped), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("type"))))
    fields = F.when(F.ltrim("header").startswith("{"), F.transform(as_json, lambda e: F.struct(e["name"].alias("name"), F.lower(F.trim(e["type"])).alias("type")))).otherwise(pcd)
    nest = F.when(F.ltrim("header").startswith("{"), F.when(F.exists(listed, lambda e: e["name"].isNotNull()), F.lit("extra_dims[]")).otherwise(F.lit("extra_dims"))).otherwise(F.lit("FIELDS"))
    rows = files.select("file_id", "series_id", "file_seq", "stage", nest.alias("nest"), F.posexplode(fields).alias("pos", "f")).select("*", F.lower(F.trim("f.name")).alias("name"), "f.type").drop("f")
    rows = rows.where(F.col("name") != "")
    return rows.groupBy("file_id", "series_id", "file_seq", "stage", "nest", "name").agg(F.min_by("type", "pos").alias("type"), F.min("pos").alias("pos"))


def neighbours(files: DataFrame) -> DataFrame:
    """(file_id, before): each file with the one before it in its series; only file metadata is ordered."""
    w = W.partitionBy("series_id").orderBy("file_seq", "file_id")
    return files.select("file_id", F.lag("file_id").over(w).alias("before")).where(F.col("before").isNotNull())


def field_sets(fields: DataFrame, pairs: DataFrame) -> DataFrame:
    """(file_id, before, name, type_new, type_old): full join of the fields of a file and of the one before it."""
    own = fields.where(~F.col("name").isin(*FIXED)).select("file_id", "name", "type")
    new = pairs.join(own, "file_id").withColumnRenamed("type", "type_new")
    old = pairs.join(own.withColumnRenamed("file_id", "before"), "before").withColumnRenamed("type", "type_old")
    return new.join(old, ["file_id", "before", "name"], "full")


def record_values(files: DataFrame, fields: DataFrame, records: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(file_id, row_no, point_idx, vals): the given values of a record as array of (name, raw text).

    ``wanted`` (file_id, want) limits the values to the named fields of its files.
    """
    heads = fields.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("pos") + 1, "name"))).alias("at"), F.first("stage").alias("stage"))
    if wanted is not None:
        heads = heads.join(wanted, "file_id")
    rows = records.select("file_id", "row_no", "payload").join(heads, "file_id")
    parts = F.split(F.trim("payload"), r"\s+")
    pcd = F.transform(parts, lambda v, i: F.struct(F.element_at("at", i + 1).alias("name"), v.alias("value")))
    as_json = F.transform(F.map_entries(F.from_json("payload", "map<string,string>")), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("name"), e["value"].alias("value")))
    vals = F.when(F.ltrim("payload").startswith("{"), as_json).otherwise(pcd)
    given = lambda e: e["name"].isNotNull() & e["value"].isNotNull() & ~F.lower(F.trim(e["value"])).isin("nan", "", "null")
    rows = rows.withColumn("vals", F.filter(vals, given))
    idx = F.expr("try_cast(filter(vals, e -> e.name = 'point_idx')[0].value as double)").cast("long")
    rows = rows.withColumn("point_idx", idx)
    if wanted is not None:
        rows = rows.withColumn("vals", F.filter("vals", lambda e: F.array_contains("want", e["name"])))
    return rows.select("file_id", "row_no", "point_idx", "vals")


def number_text(value: str) -> Column:
    """One spelling of equal numbers: whole ones without a point and to the last digit, others as the nearest double, text trimmed."""
    d = f"try_cast({value} as double)"
    whole = f"case when {d} = floor({d}) and abs({d}) < 9007199254740992 then cast(cast({d} as bigint) as string) else cast({d} as string) end"
    return F.expr(f"coalesce(cast(try_cast({value} as bigint) as string), {whole}, trim({value}))")


def value_evidence(files: DataFrame, fields: DataFrame, records: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(file_id, old_field, new_field, shared, equal): agreement of each new field with each gone one."""
    new = sets.where(F.col("type_old").isNull()).select("file_id", F.col("name").alias("new_field"))
    gone = sets.where(F.col("type_new").isNull()).select("file_id", "before", F.col("name").alias("old_field"))
    asked = new.join(gone, "file_id")  # the changed names of one pair of headers
    side = asked.select("file_id", F.col("new_field").alias("name")).union(asked.select(F.col("before").alias("file_id"), F.col("old_field").alias("name")))
    vals = record_values(files, fields, records, side.groupBy("file_id").agg(F.collect_set("name").alias("want")))
    # payloads are parsed once; both sides of the join read what was written
    flat = cut(vals.where(F.col("point_idx").isNotNull()).select("file_id", "point_idx", F.inline("vals")).select("file_id", "point_idx", "name", number_text("value").alias("value")).distinct())
    a = flat.select("file_id", "point_idx", F.col("name").alias("new_field"), F.col("value").alias("a"))
    b = flat.select(F.col("file_id").alias("before"), "point_idx", F.col("name").alias("old_field"), F.col("value").alias("b"))
    met = asked.join(a, ["file_id", "new_field"]).join(b, ["before", "old_field", "point_idx"])
    return met.groupBy("file_id", "old_field", "new_field").agg(F.count("*").alias("shared"), F.sum((F.col("a") == F.col("b")).cast("long")).alias("equal"))


def _grams(name: str) -> set[str]:
    s = f"  {name} "
    return {s[i : i + 3] for i in range(len(s) - 2)}


def name_similarity(a: str, b: str) -> float:
    """Dice coefficient of padded trigrams."""
    x, y = _grams(a), _grams(b)
    return 2 * len(x & y) / (len(x) + len(y))


def flood(old: list[tuple], new: list[tuple], agreement: dict[tuple[str, str], float], struck: set[tuple[str, str]] = frozenset()) -> np.ndarray:
    """Fixpoint scores of all pairs of fields of two schema graphs; a field is (name, type, nesting).

    Edges: root -> nesting -> field -> type and field -> next field. A pair hands its score to the pairs that its edges lead to, shared evenly
    among those of one kind. ``struck`` pairs have no likeness and pass nothing on.
    """
    oi, ni = [[(*n, "") for _, *n in side] for side in (old, new)]  # a field without nesting lies at the top
    same = lambda x, y: 1.0 if x == y else 0.5 * name_similarity(x, y)
    f0 = np.array([[same(a[0], b[0]) if a[0] == b[0] else 0.5 * name_similarity(a[0], b[0]) + 0.5 * agreement.get((a[0], b[0]), 0.0) for b in new] for a in old])
    alive = np.array([[(a[0], b[0]) not in struck for b in new] for a in old])
    f0 = f0 * alive
    hubs = []  # types and nestings: pairs of hubs, and to which of them each pair of fields belongs
    for k in (0, 1):
        left, right = sorted({x[k] for x in oi}), sorted({x[k] for x in ni})
        at = (np.array([left.index(x[k]) for x in oi])[:, None], np.array([right.index(x[k]) for x in ni])[None, :])
        h0 = np.array([[same(x, y) for y in right] for x in left])
        size = np.zeros_like(h0)
        np.add.at(size, at, 1.0)
        hubs.append([h0, h0.copy(), at, np.maximum(size, 1)])
    root0 = root = 1.0
    f = f0.copy()
    for _ in range(FLOOD_STEPS):
        fs = f0 + f
        f1 = fs.copy()
        f1[1:, 1:] += NEXT * fs[:-1, :-1]
        f1[:-1, :-1] += NEXT * fs[1:, 1:]
        grown = []
        for h0, h, at, size in hubs:
            hs, pull = h0 + h, np.zeros_like(h0)
            np.add.at(pull, at, fs)
            f1 += (hs / size)[at]
            grown.append(hs + pull)
        nests = hubs[1]
        grown[1] = grown[1] + (root0 + root) / nests[0].size
        r1 = root0 + root + (nests[0] + nests[1]).sum()
        f1 *= alive
        top = max(f1.max(), r1, *[g.max() for g in grown])
        moved = max(np.abs(f1 / top - f).max(), *[np.abs(g / top - h[1]).max() for g, h in zip(grown, hubs)])
        f, root = f1 / top, r1 / top
        for g, h in zip(grown, hubs):
            h[1] = g / top
        if moved < FLOOD_EPS:
            break
    return f


def _select_matches(rows: pa.Table) -> pa.Table:
    """Renames of one file: matches that are best for both sides by flooded score, unless their values refute them."""
    h = rows.slice(0, 1).to_pylist()[0]
    old = list(zip(h["old_names"], h["old_types"], h["old_nests"]))
    new = list(zip(h["new_names"], h["new_types"], h["new_nests"]))
    agree = {(a, b): e / s for a, b, s, e in zip(*(rows.column(c).to_pylist() for c in ("old_field", "new_field", "shared", "equal"))) if s}
    kept_names = {a for a, *_ in old} & {b for b, *_ in new}
    gone, come = [i for i, o in enumerate(old) if o[0] not in kept_names], [j for j, n in enumerate(new) if n[0] not in kept_names]
    struck, out = set(), []
    while gone and come:
        score = flood(old, new, agree, struck)
        left = {(i, j): score[i, j] for i in gone for j in come if (old[i][0], new[j][0]) not in struck}
        if not left:
            break
        # best for both: no other open pair of either field scores higher (ties by name)
        order = sorted(left, key=lambda p: (-left[p], old[p[0]][0], new[p[1]][0]))
        taken_i, taken_j, refuted = set(), set(), False
        for i, j in order:
            if i in taken_i or j in taken_j:
                continue
            taken_i.add(i)
            taken_j.add(j)
            a, b = old[i][0], new[j][0]
            if agree.get((a, b)) == 1.0:
                out.append((h["file_id"], a, b, float(left[i, j])))
                gone.remove(i)
                come.remove(j)
            else:
                struck.add((a, b))
                refuted = True
        if not refuted:
            break
    kinds = (pa.int64(), pa.string(), pa.string(), pa.float64())
    return pa.table([pa.array([r[i] for r in out], type=k) for i, k in enumerate(kinds)], names=["file_id", "old_field", "new_field", "score"])


def match_renames(fields: DataFrame, pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """(file_id, old_field, new_field, score): the selected correspondences of changed names."""
    own = fields.where(~F.col("name").isin(*FIXED)).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("pos", "name", F.coalesce("type", F.lit("")).alias("type"), "nest"))).alias("f"))
    side = lambda key, s: own.select(F.col("file_id").alias(key), *[F.col(f"f.{c}").alias(f"{s}_{c}s") for c in ("name", "type", "nest")])
    heads = pairs.join(side("file_id", "new"), "file_id").join(side("before", "old"), "before")
    return evidence.join(heads, "file_id").groupBy("file_id").applyInArrow(_select_matches, "file_id long, old_field string, new_field string, score double")


def schema_changes(files: DataFrame, records: DataFrame) -> DataFrame:
    """(file_id, change, old_field, new_field): renamed, removed, added and retyped fields of every file."""
    # header metadata, a few rows a file, which many branches read
    fields, pairs = cut(declared_fields(files)), cut(neighbours(files))
    sets = cut(field_sets(fields, pairs))
    # one row a renamed field; written once because four branches below read it
    renames = cut(match_renames(fields, pairs, value_evidence(files, fields, records, pairs, sets)).select("file_id", "old_field", "new_field"))
    none = F.lit("")
    gone = sets.where(F.col("type_new").isNull()).select("file_id", F.col("name").alias("old_field")).join(renames, ["file_id", "old_field"], "left_anti")
    new = sets.where(F.col("type_old").isNull()).select("file_id", F.col("name").alias("new_field")).join(renames, ["file_id", "new_field"], "left_anti")
    own = fields.select("file_id", F.col("name").alias("new_field"), F.col("type").alias("type_new"))
    past = pairs.join(fields.select(F.col("file_id").alias("before"), F.col("name").alias("old_field"), F.col("type").alias("type_old")), "before").drop("before")
    moved = renames.join(own, ["file_id", "new_field"]).join(past, ["file_id", "old_field"]).select("file_id", F.col("new_field").alias("name"), "type_new", "type_old")
    retyped = sets.where(F.col("type_new").isNotNull() & F.col("type_old").isNotNull()).select("file_id", "name", "type_new", "type_old").union(moved).where(F.col("type_new") != F.col("type_old"))
    return (
        renames.select("file_id", F.lit("renamed").alias("change"), "old_field", "new_field")
        .union(gone.select("file_id", F.lit("removed"), "old_field", none))
        .union(new.select("file_id", F.lit("added"), none, "new_field"))
        .union(retyped.select("file_id", F.lit("retyped"), "name", "name"))
    )


def _follow(pdf: pd.DataFrame) -> pd.DataFrame:
    """Canonical name of each field of one series: the name under which it first appeared."""
    pdf = pdf.sort_values(["file_seq", "file_id", "pos"])
    known: dict[str, str] = {}
    out = []
    for fid, rows in pdf.groupby("file_id", sort=False):
        now, taken = {}, set()
        for name, old in zip(rows.name, rows.old_field):
            canon = known.get(old if isinstance(old, str) else name, name)
            if canon in taken:  # a name that came back while its first bearer lives on
                canon = name if name not in taken else f"{name}_{fid}"
            taken.add(canon)
            now[name] = canon
        known = now
        out += [(fid, n, t, c) for n, t, c in zip(rows.name, rows.type, [now[n] for n in rows.name])]
    return pd.DataFrame(out, columns=["file_id", "name", "type", "canonical"])


def canonical_fields(files: DataFrame, records: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """(file_id, name, type, canonical): which field of the unified table a file's field becomes."""
    fields = declared_fields(files)
    changes = schema_changes(files, records) if changes is None else changes
    renames = changes.where(F.col("change") == "renamed").select("file_id", F.col("new_field").alias("name"), "old_field")
    return fields.join(renames, ["file_id", "name"], "left").groupBy("series_id").applyInPandas(_follow, "file_id long, name string, type string, canonical string")


def unified_table(files: DataFrame, records: DataFrame, stage: str, canon: DataFrame) -> DataFrame:
    """All records of a stage with one set of typed columns.

    A column is string if any file declares it so, double if any declares a float, else long. The columns are
    the canonical names found in the headers (schema metadata, read to the driver).
    """
    mine = files.where(F.col("stage") == stage)
    here = canon.join(mine.select("file_id"), "file_id", "left_semi")
    text, real = F.lower("type").rlike("str|^s"), F.lower("type").rlike("^f|float|double")
    kinds = {r["canonical"]: "string" if r["s"] else "double" if r["f"] else "bigint" for r in here.groupBy("canonical").agg(F.coalesce(F.max(text), F.lit(True)).alias("s"), F.coalesce(F.max(real), F.lit(False)).alias("f")).collect()}
    kinds |= {"point_idx": "bigint", "x": "double", "y": "double", "z": "double"}
    fields = declared_fields(mine)
    vals = record_values(mine, fields, records)
    names = here.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "canonical"))).alias("to"))
    rows = vals.join(names, "file_id").join(mine.select("file_id", "series_id", "file_seq"), "file_id")
    rows = rows.withColumn("e", F.transform("vals", lambda e: F.struct(F.coalesce(F.element_at("to", e["name"]), e["name"]).alias("name"), e["value"].alias("value"))))
    first = F.filter("e", lambda e, i: F.array_position(F.col("e.name"), e["name"]) == i + 1)
    rows = rows.withColumn("m", F.map_from_entries(first))
    cast = lambda c, k: F.expr(f"try_cast(m['{c}'] as string)") if k == "string" else F.expr(f"coalesce(try_cast(m['{c}'] as {k}), try_cast(try_cast(m['{c}'] as double) as {k}))")  # noqa: E731  a double rounds ids above 2^53
    order = [*FIXED, *sorted(set(kinds) - set(FIXED))]
    return rows.select("series_id", "file_seq", "file_id", "row_no", *[cast(c, kinds[c]).alias(c) for c in order])
