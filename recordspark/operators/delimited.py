"""Text lines of delimited exports: header, strict quoting, column profiles and the part each column plays.

All text work is JVM-side; only the per-file column metadata (a row per file and column) goes to Python.

Null, empty and hot input: a null payload counts as an empty line; a line without a file, or without a header in its
file, fails as `no_header`; the unit separator U+001F inside a line is read as U+241F. Profiles are aggregated in
`SKETCH` parts per file before they are brought together, so a file with a third of all rows is no hot group.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordspark.functions.assign import best_assignment

SKETCH = 32  # parts of a one-permutation value sketch
DELIMITERS = [",", ";", "|", "\t"]

# The parts of a shop order line and the names that the statement of the problem gives them.
PART_NAMES = {
    "order_number": ["order_number"], "created_at": ["created_at"], "customer_email": ["customer_email"], "billing_name": ["billing_name"],
    "billing_zip": ["billing_zip", "billing_postal_code"], "sku": ["sku"], "item_name": ["item_name"], "quantity": ["quantity"],
    "unit_price": ["unit_price"], "line_total": ["line_total"],
}
# The form of content that a part has; see FORMS.
PART_FORM = {
    "order_number": "order", "created_at": "time", "customer_email": "mail", "billing_name": "words", "billing_zip": "zip",
    "sku": "code", "item_name": "words", "quantity": "count", "unit_price": "number", "line_total": "number",
}
FORMS = ["order", "time", "mail", "words", "zip", "code", "count", "number", "other"]

ISO_INSTANT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"
INTEGER, DECIMAL = r"^[0-9]+$", r"^[0-9]+(\.[0-9]+)?$"


def is_instant(v: Column) -> Column:
    """A real instant written YYYY-MM-DDThh:mm:ssZ."""
    return v.rlike(ISO_INSTANT) & F.try_to_timestamp(v, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).isNotNull()


def mail_shape(v: Column) -> Column:
    """An @ with a dot somewhere after the last @."""
    return v.rlike(r"@[^@]*\.[^@]*$")


def _line(payload: Column) -> Column:
    text = F.regexp_replace(F.coalesce(payload, F.lit("")), r"\r\z", "")
    return F.translate(text, "\u001f", "␟")


def _cells(text: Column, delimiter: Column) -> Column:
    """Raw cells: delimiters outside quotation marks (even pieces between marks) become U+001F, then one split."""
    pieces = F.transform(F.split(text, '"', -1), lambda s, i: F.when(i % 2 == 0, F.replace(s, delimiter, F.lit("\u001f"))).otherwise(s))
    return F.split(F.array_join(pieces, '"'), "\u001f", -1)


def _quoting_ok(cell: Column) -> Column:
    inner = F.substring(cell, F.lit(2), F.length(cell) - 2)
    closed = (F.length(cell) >= 2) & F.endswith(cell, F.lit('"')) & ~F.contains(F.replace(inner, F.lit('""'), F.lit("")), F.lit('"'))
    return F.when(F.startswith(cell, F.lit('"')), closed).otherwise(~F.contains(cell, F.lit('"')))


def _unquoted(cell: Column) -> Column:
    inner = F.substring(cell, F.lit(2), F.length(cell) - 2)
    return F.when(F.startswith(cell, F.lit('"')) & (F.length(cell) >= 2), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(cell)


def read_headers(raw: DataFrame) -> DataFrame:
    """One row per file: source_file, delimiter, names. Of several header rows the one with the least text counts."""
    text = F.regexp_replace(_line(F.min("payload")), "^﻿", "")
    head = raw.filter("line_no = 1 and source_file is not null").groupBy("source_file").agg(text.alias("head"))
    bare = F.regexp_replace("head", '"[^"]*"', "")
    count = lambda d: F.length(bare) - F.length(F.translate(bare, d, ""))
    most = F.greatest(*[count(d) for d in DELIMITERS])
    delimiter = F.coalesce(*[F.when((count(d) == most) & (most > 0), F.lit(d)) for d in DELIMITERS], F.lit(","))
    name = lambda x: F.regexp_replace(_unquoted(F.regexp_replace(x, r"^\s+|\s+$", "")), r"^[\s﻿]+|\s+$", "")
    return head.withColumn("delimiter", delimiter).select("source_file", "delimiter", F.transform(_cells(F.col("head"), F.col("delimiter")), name).alias("names"))


def split_lines(raw: DataFrame, headers: DataFrame) -> DataFrame:
    """Records (headers aside) with `values` in header order, or `broken`, the structural reason for which they fail."""
    lines = raw.filter("line_no is null or line_no <> 1").join(headers, "source_file", "left")
    cut = lines.withColumn("_cells", _cells(_line(F.col("payload")), F.coalesce("delimiter", F.lit(","))))
    broken = (
        F.when(F.col("names").isNull(), "no_header")
        .when(~F.forall("_cells", _quoting_ok), "broken_quoting")
        .when(F.size("_cells") < F.size("names"), "too_few_fields")
        .when(F.size("_cells") > F.size("names"), "too_many_fields")
    )
    return cut.withColumn("broken", broken).withColumn("values", F.transform("_cells", _unquoted)).drop("_cells")


def profile(lines: DataFrame) -> DataFrame:
    """One row per file and column position: counts of content forms and a value sketch.

    `lines` has source_file and values; each value is hashed once and falls into one of SKETCH parts, of which the
    least hash is kept, so the sketch is bounded and partial aggregation does nearly all of the work.
    """
    v = F.col("v")
    cells = lines.select("source_file", F.posexplode("values").alias("pos", "v")).filter(v != "")
    hashed = cells.withColumn("h", F.xxhash64("v")).withColumn("part", F.pmod("h", F.lit(SKETCH)).cast("int"))
    tests = {
        "n": F.lit(True), "n_int": v.rlike(INTEGER), "n_dec": v.rlike(DECIMAL), "n_iso": v.rlike(ISO_INSTANT), "n_ts": is_instant(v),
        "n_epoch": v.rlike(r"^[0-9]{9,10}$"), "n_order": v.rlike(r"^[A-Z]-?[0-9]{6,}$"), "n_mail": F.contains(v, F.lit("@")),
        "n_zip": v.rlike(r"^[0-9]{4,5}(-[0-9]{4})?$"), "n_code": v.rlike(r"^[A-Z]{2,4}-[A-Z]+-[0-9]+$"), "n_small": v.rlike(r"^[0-9]{1,2}(\.0)?$"),
        "n_space": F.contains(v, F.lit(" ")), "n_long": F.length(v) >= 8, "n_alpha": v.rlike(r"^\p{L}[\p{L}\p{M} .,'-]*$"), "n_lower": v.rlike(r"^[a-z]"),
    }
    sums = [F.sum(t.cast("long")).alias(k) for k, t in tests.items()]
    parts = hashed.groupBy("source_file", "pos", "part").agg(*sums, F.min("h").alias("h"))
    return parts.groupBy("source_file", "pos").agg(*[F.sum(k).alias(k) for k in tests], F.collect_list(F.struct("part", "h")).alias("sketch"))


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name or "").lower()).strip("_")


def _grams(s: str) -> set[str]:
    s = f" {s.replace('_', ' ')} "
    return {s[i : i + 3] for i in range(len(s) - 2)}


@functools.lru_cache(maxsize=1 << 16)
def name_similarity(a: str, b: str) -> float:
    a, b = _plain(a), _plain(b)
    if a == b:
        return 1.0
    x, y = _grams(a), _grams(b)
    return 2 * len(x & y) / max(1, len(x) + len(y))


def _form_vector(r: pd.Series) -> np.ndarray:
    n = max(1, r["n"])
    numeric = r["n_dec"] / n
    time = max(r["n_iso"], r["n_epoch"]) / n
    small = r["n_small"] / n
    zips = 0.0 if small > 0.5 else r["n_zip"] / n
    words = r["n_alpha"] / n if not r["n_code"] and not r["n_mail"] else 0.0
    v = np.array([r["n_order"] / n, time, r["n_mail"] / n, words, zips, r["n_code"] / n, small, max(0.0, numeric - time), 0.0])
    v[-1] = max(0.0, 1 - v[:-1].max())
    return v


@functools.lru_cache(maxsize=1 << 14)
def _names_like_parts(name: str) -> tuple[float, ...]:
    return tuple(max(name_similarity(name, x) for x in names) for names in PART_NAMES.values())


Pools = dict[str, set[int]]  # part -> hashes that the sketches of columns known by name hold, over all feeds


def part_pools(meta: DataFrame) -> Pools:
    """Value sketches of the columns with a given name, pooled over all files: at most POOL hashes a part and sketch slot."""
    plain = F.regexp_replace(F.lower(F.regexp_replace("name", "(?<=[a-z0-9])(?=[A-Z])", "_")), "[^a-z0-9]+", "_")
    part = F.coalesce(*[F.when(F.trim(plain, F.lit("_")).isin(names), F.lit(p)) for p, names in PART_NAMES.items()])
    seen = meta.select(part.alias("part"), F.inline("sketch").alias("slot", "h")).filter("part is not null").groupBy("part", "slot", "h").agg(F.count("*").alias("files"))
    w = Window.partitionBy("part", "slot").orderBy(F.col("files").desc(), "h")
    out: Pools = {p: set() for p in PART_NAMES}
    for r in seen.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= POOL).select("part", "h").collect():
        out[r["part"]].add(r["h"])
    return out


def pooled_share(r: pd.Series, pools: Pools) -> dict[str, float]:
    """For each part the share of the column's sketch that columns known by name hold as well."""
    hashes = list(_sketch(r).values())
    return {p: sum(h in pool for h in hashes) / max(1, len(hashes)) for p, pool in pools.items()}


def _part_scores(r: pd.Series, pools: Pools) -> dict[str, float]:
    form, shares, out = _form_vector(r), pooled_share(r, pools), {}
    for part, by_name in zip(PART_NAMES, _names_like_parts(r["name"])):
        by_form = form[FORMS.index(PART_FORM[part])] if r["n"] else 0.4
        out[part] = (1.2 if by_name == 1 else 0.6 * by_name) + 0.5 * by_form + (0.5 * shares.get(part, 0.0) if by_name < 1 else 0.0)
    return out


def assign_parts(columns: pd.DataFrame, pools: Pools, carried: list[str | None] | None = None) -> list[str | None]:
    """The part of each column of one file: an optimal matching of columns and parts by names, content and the parts carried along."""
    parts = list(PART_NAMES)
    score = np.zeros((len(columns), len(parts)))
    for i, (_, r) in enumerate(columns.iterrows()):
        s = _part_scores(r, pools)
        score[i] = [s[p] + (CARRIED if carried and carried[i] == p else 0.0) for p in parts]
    out: list[str | None] = [None] * len(columns)
    for i, j in best_assignment(score, LEAST_PART):
        out[i] = parts[j]
    return out


LEAST_LIKENESS, LEAST_PART = 0.49, 0.6
POOL = 64
POOLED = 0.3  # what values that both columns share with one known column of any feed add to their likeness
CARRIED = 1.0  # what the part of the same column in a neighbouring file adds


def _sketch(r: pd.Series) -> dict[int, int]:
    s = r["sketch"]
    return {int(x["part"]): int(x["h"]) for x in s} if s is not None and len(s) else {}


def _form_likeness(a: pd.Series, b: pd.Series) -> float:
    """From 0 to 1, how alike two columns with values are by forms and types; numbers of another form are alike to 0.7."""
    u, v = _form_vector(a), _form_vector(b)
    shared = [FORMS.index(k) for k in ("order", "time", "mail", "zip", "code") if min(u[FORMS.index(k)], v[FORMS.index(k)]) >= 0.8]
    gap = np.abs(u - v)[shared or slice(None)]
    if not shared:
        gap = np.append(gap, [abs(a[k] / a["n"] - b[k] / b["n"]) for k in ("n_space", "n_long", "n_lower", "n_int", "n_dec")])
    noise = 1 / np.sqrt(min(a["n"], b["n"]))  # two standard errors of a difference of shares, about
    strict = 1 - min(1.0, max(0.0, float(gap.max()) - noise))
    number = min(max(x[FORMS.index(k)] for k in ("zip", "count", "number")) * (r["n_dec"] / r["n"]) for x, r in ((u, a), (v, b)))
    return max(strict, 0.7 * number)


def likeness(a: pd.Series, b: pd.Series, pools: Pools) -> float:
    """How alike two columns are by value sketches, forms, types and names, and by what both share with known columns."""
    by_name = name_similarity(a["name"], b["name"])
    if not a["n"] or not b["n"]:
        return by_name
    x, y = _sketch(a), _sketch(b)
    both = [k for k in x if k in y]
    overlap = sum(x[k] == y[k] for k in both) / max(1, len(both))
    p, q = pooled_share(a, pools), pooled_share(b, pools)
    known = max((min(p[k], q[k]) for k in pools), default=0.0)
    return 0.5 * _form_likeness(a, b) + 0.3 * max(overlap, by_name) + 0.2 * overlap + POOLED * known


def matched_files(columns: pd.DataFrame, pools: Pools) -> list[tuple[str, pd.DataFrame, list[str | None], dict[str, str]]]:
    """The files of one feed in order of month: name, columns by position, their parts, and the old name of each renamed column.

    Names that are the same in both files stay the same column; the others are matched by `likeness`. Parts are carried
    along the chain of matched columns, forwards and then backwards, so that one file that names a column is enough.
    """
    by_file = {f: g.sort_values("pos") for f, g in columns.groupby("source_file", sort=False)}
    order = list(columns[["month", "source_file"]].drop_duplicates().sort_values(["month", "source_file"])["source_file"])
    chain: list[dict[str, str]] = []
    old: dict[str, pd.Series] = {}
    for f in order:
        now = {r["name"]: r for _, r in by_file[f].drop_duplicates("name").iterrows()}
        gone, fresh = [k for k in old if k not in now], [k for k in now if k not in old]
        score = np.array([[likeness(old[a], now[b], pools) for b in fresh] for a in gone]).reshape(len(gone), len(fresh))
        chain.append({fresh[j]: gone[i] for i, j in best_assignment(score, LEAST_LIKENESS)})
        old = now
    own = [_known(by_file[f], assign_parts(by_file[f], pools)) for f in order]
    for i in range(1, len(order)):  # forwards, then backwards
        own[i] = _carry(by_file[order[i]], pools, own[i - 1], {k: chain[i].get(k, k) for k in by_file[order[i]]["name"]})
    for i in range(len(order) - 2, -1, -1):
        ahead = {a: b for b, a in chain[i + 1].items()}
        own[i] = _carry(by_file[order[i]], pools, own[i + 1], {k: ahead.get(k, k) for k in by_file[order[i]]["name"]}, own[i])
    return [(f, by_file[f], [p for p in own[i]["parts"]], chain[i]) for i, f in enumerate(order)]


def _known(g: pd.DataFrame, parts: list[str | None]) -> dict:
    return {"parts": parts, "by_name": {k: p for k, p in sorted(zip(g["name"], parts), key=lambda x: x[1] or "")}}


def _carry(g: pd.DataFrame, pools: Pools, neighbour: dict, link: dict[str, str], had: dict | None = None) -> dict:
    """Parts of a file given those of a neighbouring one; backwards only columns without a part take one from ahead."""
    ahead = [neighbour["by_name"].get(link[k]) for k in g["name"]]
    if had is not None:
        if not any(p is None and a and a not in had["parts"] for p, a in zip(had["parts"], ahead)):
            return had
        ahead = [p or a for p, a in zip(had["parts"], ahead)]
    return _known(g, assign_parts(g, pools, ahead))


COUNTS = ["n", "n_int", "n_dec", "n_iso", "n_ts", "n_epoch", "n_order", "n_mail", "n_zip", "n_code", "n_small", "n_space", "n_long", "n_alpha", "n_lower"]


def column_metadata(headers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every column of every file with its profile (zeros where it has no values), feed and month of the file."""
    cols = headers.select("source_file", F.posexplode("names").alias("pos", "name"))
    feed = F.regexp_extract("source_file", r"^(.*)_[0-9]{4}-[0-9]{2}\.[A-Za-z0-9]+$", 1)
    month = F.regexp_extract("source_file", r"_([0-9]{4}-[0-9]{2})\.[A-Za-z0-9]+$", 1)
    return (
        cols.join(profiles, ["source_file", "pos"], "left")
        .fillna(0, COUNTS)
        .withColumn("feed", F.when(feed != "", feed).otherwise(F.col("source_file")))
        .withColumn("month", month)
    )


def file_parts(meta: DataFrame, pools: Pools) -> DataFrame:
    """Per file: the part of each column position and the form of its creation time (`iso` or `epoch`)."""

    def per_feed(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for f, g, parts, _ in matched_files(pdf, pools):
            form = next(("epoch" if r["n_epoch"] > r["n_iso"] else "iso" for p, (_, r) in zip(parts, g.iterrows()) if p == "created_at"), "iso")
            rows.append((f, [p or "" for p in parts], form))
        return pd.DataFrame(rows, columns=["source_file", "parts", "time_form"])

    return meta.groupBy("feed").applyInPandas(per_feed, "source_file string, parts array<string>, time_form string")
