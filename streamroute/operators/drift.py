"""Schemas that drift between files: one consistent table and a report of each change.

Events are loaded as path-value maps with raw types; per file the statistics of every path are counted as mergeable
numbers (how many events carry it, with which types, and a profile of the values: 64-bit hashes of their written forms, their
decimals and magnitudes). Files are then compared in order, renames are recognised by profile, and
the columns are projected with the type most files agree on, failed casts being reported.

Only counts are shuffled: one row per path, file and statistic, however many events there are. Forms of texts may be
as many as the values; they are joined pair by pair where a rename is in question and never go to one task.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamroute.operators.nested import _array, events_of, kind_of, text_of
from streamroute.session import JOIN_SALTS, join_small, materialize, shuffled

#: A field belongs to a topic and file if at least one in so many events carries it.
ONE_IN = 5
#: From half of so many forms on a vocabulary is open, however many values show them.
FORMS = 4096
#: Least overlap of two profiles of strings, largest distance of two profiles of numbers, largest quotient of their ranges' ends.
SAME_FORMS, SAME_NUMBERS, SAME_RANGE = 0.25, 0.5, 1.6
#: Least share of common forms among all forms of two profiles whose overlap is below CLEAR (one shared form may be chance).
SAME_VOCABULARY, CLEAR = 0.3, 0.6
#: Least share of common fields for a topic to be another one renamed.
SAME_FIELDS = 0.6
#: What counts as a number when a text is cast (the engine's own cast takes endings like 7d and words like NaN as well).
DECIMAL = r"^\s*[-+]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][-+]?[0-9]+)?\s*$"
#: Different values a task keeps the profiles of.
KNOWN_VALUES = 100_000
#: Rows and bytes a side of a join may hold to be broadcast here. The driver holds what is broadcast, of several joins at
#: once; sides that grow with the gateways mustn't pass through it.
JOIN_ROWS, JOIN_BYTES = 20_000, 4 << 20
#: Copies of the smaller side where statistics and fields shuffle to join: fields are millions, of their rows only forms are many a key.
JOIN_COPIES = 8
#: Magnitude buckets per factor of two, and significant digits that a double always holds.
PER_OCTAVE, FULL = 4, 15

_HEX = re.compile(r"(?<![0-9a-zA-Z])(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f0-9])[0-9a-f]{7,}(?![0-9a-zA-Z])")
_DIGITS = re.compile(r"\d+")
_UPPER, _LOWER = re.compile(r"[A-Z]+"), re.compile(r"[^\W\d_A-Z]+")


def forms(v: str) -> tuple[str, str]:
    """A text's form with digits and hex numbers masked, and with letters masked as well."""
    near = _DIGITS.sub("9", _HEX.sub("#", v))
    far = _LOWER.sub("a", _UPPER.sub("A", near))
    return near, re.sub(r"(?:[aA] ?)+", "a", far)


def _hash(form: str) -> str:
    return hashlib.blake2b(form.encode("utf-8", "replace"), digest_size=8).hexdigest()


def profile(v) -> list[str]:
    """Statistics a value counts towards."""
    if isinstance(v, bool):
        return ["b"]
    if type(v) is str:
        near, far = forms(v)
        return [f"s{_hash(near)}", f"S{_hash(far)}"]
    # decimals as a double shows them; one with all digits of a double is of full precision, however many they are
    whole, _, digits = repr(float(v)).partition("e")[0].partition(".")
    digits = digits.rstrip("0")
    decimals = FULL if len((whole.lstrip("-0") + digits).lstrip("0")) >= FULL and digits else len(digits)
    x = float(v)
    if x == 0:
        size = "0"
    else:
        size = str(math.floor(math.log2(abs(x)) * PER_OCTAVE) if math.isfinite(x) else 9999)
        size = ("-" if x < 0 else "") + "m" + size
    return [f"d{decimals}", f"q{size}"]


def _join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", copies: int = JOIN_SALTS) -> DataFrame:
    return join_small(big, small, on, how, JOIN_ROWS, copies, JOIN_BYTES)


STATS = "gateway_id string, topic string, file_no int, path string, stat string, n bigint"


def file_statistics(requests: DataFrame) -> DataFrame:
    """Counts per gateway, topic, file, path and statistic over events whose data is an object.

    Path '' and stat 'events' count the events; 'has' the events carrying a path; 'type:...' those showing a type.
    Each task merges the counts of an Arrow batch before anything is shuffled. Rows without gateway or file number and
    events without topic belong to no file's topic and are left out.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        # what equal values count towards, kept for as many different ones as fit
        known: tuple[dict, dict] = ({}, {})
        for batch in batches:
            counts: dict[tuple, dict[str, dict[str, int]]] = {}
            for gateway, file_no, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for _, topic, data, _ in events_of(body):
                    if topic is None or not isinstance(data, dict):
                        continue
                    if (paths := counts.get((gateway, topic, file_no))) is None:
                        counts[gateway, topic, file_no] = paths = {"": {"events": 0}}
                    paths[""]["events"] = paths[""].get("events", 0) + 1
                    kinds: dict[str, str | set] = {}
                    for path, v in leaves(data):
                        if v is None:
                            continue
                        if (at := paths.get(path)) is None:
                            paths[path] = at = {}
                        memo = known[type(v) is str]
                        if (told := memo.get(v)) is None:
                            if len(memo) >= KNOWN_VALUES:
                                memo.clear()
                            memo[v] = told = (kind_of(v), *profile(v))
                        kind = told[0]
                        for stat in told[1:]:
                            at[stat] = at.get(stat, 0) + 1
                        if kinds.get(path, kind) == kind:
                            kinds[path] = kind
                        else:
                            kinds[path] = {kind, *([kinds[path]] if isinstance(kinds[path], str) else kinds[path])}
                    for path, ks in kinds.items():
                        at = paths[path]
                        at["has"] = at.get("has", 0) + 1
                        for k in (ks,) if isinstance(ks, str) else ks:
                            at[f"type:{k}"] = at.get(f"type:{k}", 0) + 1
            rows = [(*where, path, stat, n) for where, paths in counts.items() for path, stats in paths.items() for stat, n in stats.items()]
            cols = list(zip(*rows)) if rows else [[] for _ in range(6)]
            arrays = [_array(list(c), t) for c, t in zip(cols, [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64()])]
            yield pa.RecordBatch.from_arrays(arrays, names=["gateway_id", "topic", "file_no", "path", "stat", "n"])

    rows = requests.where("gateway_id is not null and file_no is not null").select("gateway_id", F.col("file_no").cast("int"), "body")
    part = rows.mapInArrow(run, STATS)
    return part.groupBy("gateway_id", "topic", "file_no", "path", "stat").agg(F.sum("n").alias("n"))


def leaves(data: dict) -> Iterator[tuple[str, object]]:
    """(path with [] after arrays' names, raw scalar) of an object, in document order, without recursion."""
    stack: list[tuple[object, str]] = [(data, "")]
    while stack:
        v, path = stack.pop()
        if isinstance(v, dict):
            stack.extend((x, f"{path}.{k}" if path else k) for k, x in reversed(v.items()))
        elif isinstance(v, list):
            stack.extend((x, f"{path}[]") for x in reversed(v))
        else:
            yield path, v


class Field:
    """A path's merged statistics in one file."""

    def __init__(self, stats: dict[str, int]):
        self.has = stats.get("has", 0)
        types = [(n, k) for s, n in stats.items() if s.startswith("type:") for k in [s[5:]]]
        self.type = max(types, key=lambda x: (x[0], x[1]))[1] if types else "null"
        self.of = {c: _shares({s[1:]: n for s, n in stats.items() if s[:1] == c}) for c in "dq"}
        self.n = {c: (stats.get(f"values:{c}", 0), stats.get(f"forms:{c}", 0)) for c in "sS"}


def _shares(counts: dict[str, int]) -> dict[str, float]:
    total = sum(counts.values())
    return {k: n / total for k, n in counts.items()} if total else {}


def _order(size: str) -> float:
    """Sort key of a magnitude bucket."""
    if size == "0":
        return 0.0
    sign, m = (-1, size[2:]) if size.startswith("-") else (1, size[1:])
    return sign * (float(m) + 1e5)


def alike(a: Field, b: Field, common: dict[str, tuple[float, int]]) -> float:
    """0 if the two fields' values are of different kinds, else how alike they are (up to 1). common: for two texts the
    exact overlap of their forms (s) and of their forms without letters (S), and how many forms they share."""
    if a.type != b.type:
        return 0.0
    if a.type == "boolean":
        return 1.0
    if a.type == "string":
        near, shared = common.get("s", (0.0, 0))
        if near < CLEAR and shared < SAME_VOCABULARY * (a.n["s"][1] + b.n["s"][1] - shared):
            near = 0.0
        is_open = all(k > 0.5 * min(n, FORMS) and n >= 8 for n, k in (a.n["s"], b.n["s"]))
        score = max(near, common.get("S", (0.0, 0))[0] if is_open else 0.0)
        return score if score >= SAME_FORMS else 0.0
    da, db = a.of["d"], b.of["d"]
    whole_a, whole_b = da.get("0", 0.0), db.get("0", 0.0)
    if abs(whole_a - whole_b) > 0.5 or abs(max(map(int, da)) - max(map(int, db))) > 1:
        return 0.0
    sizes = sorted({*a.of["q"], *b.of["q"]}, key=_order)
    far = up_a = up_b = 0.0
    for s in sizes:
        up_a, up_b = up_a + a.of["q"].get(s, 0.0), up_b + b.of["q"].get(s, 0.0)
        far = max(far, abs(up_a - up_b))
    ends = [max(_order(s) for s in f.of["q"]) for f in (a, b)]
    if far > SAME_NUMBERS or abs(ends[0] - ends[1]) > PER_OCTAVE * math.log2(SAME_RANGE) + 1:
        return 0.0
    return 1.0 - far


def _near_names(p: str, q: str) -> tuple:
    """Tie-breaks between candidates: same parent, same last name, common letters."""
    pp, qp, pl, ql = p.rpartition(".")[0], q.rpartition(".")[0], p.rpartition(".")[2], q.rpartition(".")[2]
    common = sum((Counter(pl.lower()) & Counter(ql.lower())).values()) / max(len(pl), len(ql), 1)
    return (pp == qp or pl == ql, p.count("[]") == q.count("[]"), common)


def renames(old: dict[str, Field], new: dict[str, Field], common: Callable) -> dict[str, str]:
    """Pairs of a field that leaves and one that enters with the same kind of values, the surest pairs first."""
    gone, come = [p for p in old if p not in new], [p for p in new if p not in old]
    pairs = []
    for p in gone:
        for q in come:
            if (score := alike(old[p], new[q], common(p, q))) > 0:
                pairs.append((_near_names(p, q)[0], round(score, 1), *_near_names(p, q)[1:], p, q))
    out: dict[str, str] = {}
    for *_, p, q in sorted(pairs, key=lambda x: (x[:-2], [-ord(c) for c in x[-2] + x[-1]]), reverse=True):
        if p not in out and q not in out.values():
            out[p] = q
    return out


CHANGES = "gateway_id string, topic string, file_no int, change_kind string, field_path string, new_name string"


def _schemas(rows: list[tuple]) -> dict[int, dict[str, Field]]:
    """Of one gateway's topic (rows of file_no, path, stat, n): the fields of each file, files in order."""
    stats: dict = defaultdict(lambda: defaultdict(dict))
    events = set()
    for file_no, path, stat, n, *_ in rows:
        if stat == "events" and path == "":
            events.add(file_no)
        else:
            stats[file_no][path][stat] = n
    return {f: {p: x for p, s in stats[f].items() if "has" in s and (x := Field(s)).type != "null"} for f in sorted(events)}


_PAIR = ["topic_a", "file_a", "path_a", "topic_b", "file_b", "path_b"]
PAIRS = "gateway_id string, topic_a string, file_a int, path_a string, topic_b string, file_b int, path_b string"


def _each_topic(df: DataFrame, run_topic: Callable[[str, str, list[tuple]], list[tuple]], schema: str, more: list[str] = ()) -> DataFrame:
    """run_topic(gateway, topic, its rows) for every gateway's topic. Sorted rows stream through; a task holds one topic's."""
    cols = ["gateway_id", "topic", "file_no", "path", "stat", "n", *more]
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [c.split()[1] for c in schema.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def give(rows: list[tuple]):
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if k == "string" else pa.int32()) for c, k in zip(columns, kinds)], names=names)

        key, rows, out = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(cols)))):
                if row[:2] != key:
                    if rows:
                        out += run_topic(*key, rows)
                    key, rows = row[:2], []
                rows.append(row[2:])
            if len(out) > 10_000:
                yield give(out)
                out = []
        if rows:
            out += run_topic(*key, rows)
        yield give(out)

    return df.select(*cols).repartition("gateway_id", "topic").sortWithinPartitions("gateway_id", "topic").mapInArrow(run, schema)


def value_pairs(gateway: str, topic: str, rows: list[tuple]) -> list[tuple]:
    """Pairs of text fields, and of number fields, of one gateway's topic that leave and enter in the same file."""
    schema, out = _schemas(rows), []
    for (a, old), (b, new) in zip(schema.items(), list(schema.items())[1:]):
        come = [q for q in new if q not in old]
        out += [(gateway, topic, a, p, topic, b, q) for p in old if p not in new for q in come if old[p].type == new[q].type != "boolean"]
    return out


def compare_topic(gateway: str, topic: str, rows: list[tuple]) -> list[tuple]:
    """All changes of fields between one topic's files, from their statistics and the exact overlaps of their pairs of
    texts (rows with stat 'overlap:' and the kind of forms)."""
    schema = _schemas([r for r in rows if not r[2].startswith("overlap:")])
    found: dict = defaultdict(dict)
    for a, p, stat, shared, b, q, common in rows:
        if stat.startswith("overlap:"):
            kind = stat[8:]
            found[a, p, b, q][kind] = (int(common) / (schema[a][p].n[kind][0] * schema[b][q].n[kind][0]), shared)
    out = []
    for (a, old), (b, new) in zip(schema.items(), list(schema.items())[1:]):
        named = renames(old, new, lambda p, q: found.get((a, p, b, q), {}))
        out += [(gateway, topic, b, "renamed", p, q) for p, q in named.items()]
        out += [(gateway, topic, b, "removed", p, "") for p in old if p not in new and p not in named]
        out += [(gateway, topic, b, "added", q, "") for q in new if q not in old and q not in named.values()]
        out += [(gateway, topic, b, "retyped", p, "") for p in old if p in new and old[p].type != new[p].type]
    return out


_TURN = ["gateway_id", "topic_a", "file_a", "topic_b", "file_b"]
TURNS = "gateway_id string, topic_a string, file_a int, topic_b string, file_b int, share double"


def compare_turn(pdf: pd.DataFrame, overlaps: pd.DataFrame) -> pd.DataFrame:
    """What share of the fields of a topic that ends and one that begins are the same, in name and in kind of values. pdf:
    the statistics of their common fields (side a or b) and the number of all their fields (side '')."""
    columns = [c.split()[0] for c in TURNS.split(", ")]
    if pdf.empty:
        return pd.DataFrame(columns=columns)
    stats: dict = defaultdict(lambda: defaultdict(dict))
    for side, path, stat, n in zip(pdf["side"], pdf["path"], pdf["stat"], pdf["n"]):
        stats[side][path][stat] = int(n)
    old, new = ({p: Field(x) for p, x in stats[side].items()} for side in "ab")
    found: dict = defaultdict(dict)
    for p, kind, common, shared in zip(*(overlaps[c] for c in ("path_a", "kind", "common", "shared"))):
        found[p][kind] = (int(common) / (old[p].n[kind][0] * new[p].n[kind][0]), int(shared))
    same = sum(alike(old[p], new[p], found.get(p, {})) > 0 for p in old if p in new)
    return pd.DataFrame([(*pdf[_TURN].iloc[0], same / max(1, stats[""][""]["union"]))], columns=columns)


def match_turns(pdf: pd.DataFrame) -> pd.DataFrame:
    """Renamed topics between two files of a gateway: the surest pairs first, each topic in one."""
    used: set[str] = set()
    rows = []
    for share, t, u, b in sorted(zip(-pdf["share"], pdf["topic_a"], pdf["topic_b"], pdf["file_b"])):
        if ("a", t) not in used and ("b", u) not in used:
            used |= {("a", t), ("b", u)}
            rows.append((pdf["gateway_id"].iloc[0], t, b, "topic_renamed", "", u))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in CHANGES.split(", ")])


def turns(events: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics that may be renamed: (pairs with n_union, their common fields with both types).

    A pair is a topic whose rows end with a file and one whose rows begin with the gateway's next file, sharing at least
    SAME_FIELDS of their fields. Pairs are found by prefixes: fields are ordered by how rare they are at that turn, and
    two topics that share so many must share one of the rarest few of each. So no topic is set against all others.
    """
    span = events.groupBy("gateway_id", "topic").agg(F.min("file_no").alias("first"), F.max("file_no").alias("last"))
    files = events.select("gateway_id", "file_no").distinct()
    step = files.select("gateway_id", F.col("file_no").alias("last"), F.lead("file_no").over(Window.partitionBy("gateway_id").orderBy("file_no")).alias("turn")).where("turn is not null")
    ends = span.join(shuffled(step), ["gateway_id", "last"]).select("gateway_id", "turn", "topic", F.col("last").alias("file_no"), F.lit("a").alias("side"))
    begins = span.join(shuffled(step.select("gateway_id", "turn")), ["gateway_id"]).where("first = turn").select("gateway_id", "turn", "topic", F.col("first").alias("file_no"), F.lit("b").alias("side"))
    fields = ends.unionByName(begins).join(shuffled(types), ["gateway_id", "topic", "file_no"])
    mine = Window.partitionBy("gateway_id", "turn", "side", "topic")
    rare = fields.groupBy("gateway_id", "turn", "path").agg(F.count(F.lit(1)).alias("freq"))
    fields = fields.join(shuffled(rare), ["gateway_id", "turn", "path"]).withColumns({"n_fields": F.count(F.lit(1)).over(mine), "rank": F.row_number().over(mine.orderBy("freq", "path"))})
    fields = materialize(fields, "drift-turn-fields")

    def side(x: str, df: DataFrame) -> DataFrame:
        named = {"topic": f"topic_{x}", "file_no": f"file_{x}", "type": f"type_{x}", "n_fields": f"n_{x}"}
        return df.where(F.col("side") == x).select("gateway_id", "turn", "path", *[F.col(k).alias(v) for k, v in named.items()])

    prefix = fields.where(F.col("rank") <= F.col("n_fields") - F.ceil(F.col("n_fields") * SAME_FIELDS - 1e-9) + 1)
    near = side("a", prefix).join(shuffled(side("b", prefix)), ["gateway_id", "turn", "path"]).select(*_TURN, "turn").distinct()
    both = near.join(shuffled(side("a", fields)), ["gateway_id", "turn", "topic_a", "file_a"]).join(shuffled(side("b", fields)), ["gateway_id", "turn", "topic_b", "file_b", "path"])
    n = both.groupBy(*_TURN, "n_a", "n_b").agg(F.count(F.lit(1)).alias("n_both")).withColumn("n_union", F.col("n_a") + F.col("n_b") - F.col("n_both"))
    pairs = n.where(F.col("n_both") >= F.col("n_union") * SAME_FIELDS).select(*_TURN, "n_union")
    return pairs, both.select(*_TURN, "path", "type_a", "type_b").join(shuffled(pairs.select(*_TURN)), _TURN, "left_semi")


def _overlaps(forms: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair of fields and kind of form (s, S): the sum over common forms of the smaller share, times the product of
    both fields' values (whole numbers, so exact in any order), and the number of common forms."""
    at = ["gateway_id", "topic", "file_no", "path"]

    def side(x: str) -> DataFrame:
        p = pairs.withColumns({"topic": F.col(f"topic_{x}"), "file_no": F.col(f"file_{x}"), "path": F.col(f"path_{x}")})
        n = [F.when(F.lit(x == y), F.col(c)).otherwise(0).cast("decimal(19,0)").alias(f"{c}_{y}") for c in ("n", "of") for y in "ab"]
        return _join(forms, p, at, copies=JOIN_COPIES).select("gateway_id", *_PAIR, "kind", "stat", *n)

    both = side("a").unionByName(side("b")).groupBy("gateway_id", *_PAIR, "kind", "stat").agg(*[F.max(c).alias(c) for c in ("n_a", "n_b", "of_a", "of_b")])
    both = both.where("n_a > 0 and n_b > 0")
    least = F.least(F.col("n_a") * F.col("of_b"), F.col("n_b") * F.col("of_a"))
    return both.groupBy("gateway_id", *_PAIR, "kind").agg(F.sum(least).cast("string").alias("common"), F.count(F.lit(1)).alias("shared"))


def changes(statistics: DataFrame) -> DataFrame:
    """The report of changes.

    Fields are compared topic by topic, topics that end and begin pair by pair. A task gets the statistics of one topic's
    fields (neither its events nor the forms of its texts), at most ONE_IN times as many paths a file as its events carry
    on average, so neither topics nor keys that are data (ids as names) gather in one task. Of the pairs of topics only
    names and shares come together, by gateway and file.
    """
    at = ["gateway_id", "topic", "file_no", "path"]
    first = F.substring("stat", 1, 1)
    part = F.when((F.col("path") == "") & (F.col("stat") == "events"), "events").when(F.col("stat") == "has", "has").when(first.isin("s", "S"), "form").when(first.isin("d", "q"), "number").otherwise("type")
    # kept by kind of statistic, so that each of the following steps reads its own only
    kept = materialize(statistics.withColumn("part", part), "drift-statistics", ["part"])
    of = lambda name: kept.where(F.col("part") == name).drop("part")
    fields = _join(of("has"), of("events").select(*at[:3], F.col("n").alias("events")), at[:3], copies=JOIN_COPIES)
    fields = materialize(fields.where(F.col("n") * ONE_IN >= F.col("events")).select(*at, "stat", "n"), "drift-fields")
    belongs = fields.select(*at)
    forms = materialize(_join(of("form"), belongs, at, "left_semi", JOIN_COPIES).withColumn("kind", first), "drift-forms")
    sums = materialize(forms.groupBy(*at, "kind").agg(F.sum("n").alias("of"), F.count(F.lit(1)).alias("forms")), "drift-sums")
    of_types = _join(of("type").where("startswith(stat, 'type:')"), belongs, at, "left_semi", JOIN_COPIES)
    small = fields.unionByName(of_types).unionByName(of("events"))
    for name, n in (("values:", "of"), ("forms:", "forms")):
        small = small.unionByName(sums.select(*at, F.concat(F.lit(name), "kind").alias("stat"), F.col(n).alias("n")))
    small = materialize(small, "drift-fields-of-topics")
    kind = F.substring("stat", 6, 99)
    types = small.where("startswith(stat, 'type:')").groupBy(*at).agg(F.max_by(kind, F.struct("n", kind)).alias("type"))
    turn_pairs, turn_fields = turns(of("events"), types)
    turn_pairs, turn_fields = materialize(turn_pairs, "drift-turns"), materialize(turn_fields, "drift-common")
    pairs = _each_topic(small, value_pairs, PAIRS)
    crossing = turn_fields.where("type_a = type_b and type_a <> 'boolean'").withColumns({"path_a": F.col("path"), "path_b": F.col("path")})
    pairs = materialize(pairs.unionByName(crossing.select("gateway_id", *_PAIR)), "drift-pairs")
    asked = pairs.select("gateway_id", F.explode(F.array(*[F.struct(F.col(f"topic_{x}").alias("topic"), F.col(f"file_{x}").alias("file_no"), F.col(f"path_{x}").alias("path")) for x in "ab"])).alias("f"))
    asked = asked.select("gateway_id", "f.*").distinct()
    # decimals and magnitudes are wanted for the fields of pairs only
    small = materialize(small.unionByName(_join(of("number"), asked, at, "left_semi", JOIN_COPIES)), "drift-compared")
    sums = _join(sums.select(*at, "kind", "of"), asked, at, "left_semi", JOIN_COPIES)
    forms = _join(forms, sums, [*at, "kind"], copies=JOIN_COPIES)
    overlaps = materialize(_overlaps(forms, pairs), "drift-overlaps")
    own = overlaps.where("topic_a = topic_b").select(
        "gateway_id", F.col("topic_a").alias("topic"), F.col("file_a").alias("file_no"), F.col("path_a").alias("path"), F.concat(F.lit("overlap:"), "kind").alias("stat"), F.col("shared").alias("n"), "file_b", "path_b", "common"
    )
    changed = _each_topic(small.unionByName(own, allowMissingColumns=True), compare_topic, CHANGES, ["file_b", "path_b", "common"])

    def of_side(x: str) -> DataFrame:
        named = turn_fields.select(*_TURN, "path", F.col(f"topic_{x}").alias("topic"), F.col(f"file_{x}").alias("file_no"))
        return _join(small, named, at, copies=JOIN_COPIES).select(*_TURN, F.lit(x).alias("side"), "path", "stat", "n")

    facts = turn_pairs.select(*_TURN, F.lit("").alias("side"), F.lit("").alias("path"), F.lit("union").alias("stat"), F.col("n_union").alias("n"))
    facts = facts.unionByName(of_side("a")).unionByName(of_side("b"))
    shares = facts.groupBy(*_TURN).cogroup(overlaps.where("topic_a <> topic_b").groupBy(*_TURN)).applyInPandas(compare_turn, TURNS)
    renamed = shares.where(F.col("share") >= SAME_FIELDS).groupBy("gateway_id", "file_b").applyInPandas(match_turns, CHANGES)
    return changed.unionByName(renamed)


def _chains(pdf: pd.DataFrame) -> pd.DataFrame:
    """Last names: every topic and path that was renamed, and what it is called in the end."""
    by_file = pdf.sort_values(["file_no", "field_path"])
    topic_end: dict[str, str] = {}
    for t, u in zip(*(by_file.loc[by_file["change_kind"] == "topic_renamed", c] for c in ("topic", "new_name"))):
        for k in [k for k, v in topic_end.items() if v == t]:
            topic_end[k] = u
        topic_end[t] = u
    path_end: dict[tuple[str, str], str] = {}
    for t, p, q in zip(*(by_file.loc[by_file["change_kind"] == "renamed", c] for c in ("topic", "field_path", "new_name"))):
        top = topic_end.get(t, t)
        for k in [k for k, v in path_end.items() if k[0] == top and v == p]:
            path_end[k] = q
        path_end[top, p] = q
        path_end.pop((top, q), None)
    rows = [(t, "", u) for t, u in topic_end.items()] + [(t, p, q) for (t, p), q in path_end.items()]
    out = pd.DataFrame(rows, columns=["name", "path", "last"])
    out.insert(0, "gateway_id", pdf["gateway_id"].iloc[0])
    return out


def last_names(report: DataFrame) -> DataFrame:
    return report.where("change_kind in ('renamed', 'topic_renamed')").groupBy("gateway_id").applyInPandas(_chains, "gateway_id string, name string, path string, last string")


def _classes(pdf: pd.DataFrame) -> pd.DataFrame:
    """One name for all names that renames connect, within one scope. Rows: 'edge' (a renamed to b in n gateways), 'apart'
    (a and b live side by side somewhere) and 'vote' (n gateways end with name a). Edges are taken the most frequent
    first; one that would bring two names living apart under one name is left to its own gateways."""
    near: dict[str, set[str]] = {}
    apart = set()
    votes: Counter = Counter()
    for kind, a, b, n in zip(pdf["kind"], pdf["a"], pdf["b"], pdf["n"]):
        if kind == "apart":
            apart |= {(a, b), (b, a)}
        elif kind == "vote":
            votes[a] += int(n)
    edges = pdf.loc[pdf["kind"] == "edge"]
    for _, a, b in sorted(zip(-edges["n"], edges["a"], edges["b"])):
        x, y = near.setdefault(a, {a}), near.setdefault(b, {b})
        if x is not y and not any((i, j) in apart for i in x for j in y):
            x |= y
            near |= {k: x for k in y}
    rows = [(k, max(sorted(c), key=lambda m: votes[m])) for k, c in near.items()]
    out = pd.DataFrame(rows, columns=["name", "one_name"])
    out.insert(0, "scope", pdf["scope"].iloc[0])
    return out


def _side_by_side(sets: DataFrame, one_in: int) -> DataFrame:
    """Pairs of names that a gateway uses side by side. sets: gateway_id, scope, names (array), n (how often the set)."""
    pairs = sets.select("gateway_id", "scope", "n", F.explode("names").alias("a"), "names").select("gateway_id", "scope", "n", "a", F.explode("names").alias("b"))
    pairs = pairs.groupBy("gateway_id", "scope", "a", "b").agg(F.sum("n").alias("n"))
    single = pairs.where("a = b").select("gateway_id", "scope", "a", F.col("n").alias("n_a"))
    other = single.select("gateway_id", "scope", F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    both = pairs.where("a < b").join(shuffled(single), ["gateway_id", "scope", "a"]).join(shuffled(other), ["gateway_id", "scope", "b"])
    return both.where(F.col("n") * one_in >= F.least("n_a", "n_b")).select("scope", F.lit("apart").alias("kind"), "a", "b", F.lit(1).cast("bigint").alias("n")).distinct()


def one_names(edges: DataFrame, sets: DataFrame, ends: DataFrame, one_in: int) -> DataFrame:
    """scope, name, one_name over all gateways: the name of a class is the one most gateways end with. edges: gateway_id,
    scope, a, b; sets as in _side_by_side; ends: gateway_id, scope, a. Only names are brought together, no rows."""
    e = edges.groupBy("scope", "a", "b").agg(F.count_distinct("gateway_id").alias("n")).select("scope", F.lit("edge").alias("kind"), "a", "b", "n")
    votes = ends.groupBy("scope", "a").agg(F.count_distinct("gateway_id").alias("n")).select("scope", F.lit("vote").alias("kind"), "a", F.lit("").alias("b"), "n")
    facts = e.unionByName(_side_by_side(sets, one_in)).unionByName(votes)
    return facts.groupBy("scope").applyInPandas(_classes, "scope string, name string, one_name string")


LEAVES = "request_id bigint, event_no int, gateway_id string, file_no int, topic string, path string, kind string, value string, ordinal bigint"


def path_values(requests: DataFrame) -> DataFrame:
    """Every non-null scalar of every event whose data is an object, with its raw type."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in LEAVES.split(", ")]
        for batch in batches:
            rows = []
            for rid, gateway, file_no, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for event_no, topic, data, _ in events_of(body):
                    if topic is not None and isinstance(data, dict):
                        rows += [(rid, event_no, gateway, file_no, topic, p, kind_of(v), text_of(v), i) for i, (p, v) in enumerate(leaves(data)) if v is not None]
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([_array(list(c), t) for c, t in zip(cols, types)], names=names)

    slim = requests.where("gateway_id is not null and file_no is not null").select("request_id", "gateway_id", F.col("file_no").cast("int"), "body")
    return slim.mapInArrow(run, LEAVES)


def consistent_values(requests: DataFrame, report: DataFrame) -> DataFrame:
    """path_values under one name a topic and path over all gateways (last_topic, last_path), with each path's one type
    (that most of its values show) and whether the value can be cast to it.

    A gateway's names first become its own last ones; last names that a rename connects in any gateway are then one
    class under the name most gateways end with, unless a gateway uses two of them side by side.
    """
    report = materialize(report.where("change_kind in ('renamed', 'topic_renamed')"), "renames")
    names = materialize(last_names(report), "last-names")
    topics = names.where("path = ''").select("gateway_id", F.col("name").alias("topic"), F.col("last").alias("own_topic"))
    paths = names.where("path <> ''").select("gateway_id", F.col("name").alias("own_topic"), "path", F.col("last").alias("own_path"))
    v = _join(path_values(requests), topics, ["gateway_id", "topic"], "left").withColumn("own_topic", F.coalesce("own_topic", "topic"))
    v = materialize(_join(v, paths, ["gateway_id", "own_topic", "path"], "left").withColumn("own_path", F.coalesce("own_path", "path")), "own-values")

    scope = F.lit("").alias("scope")
    edges = report.where("change_kind = 'topic_renamed'").select("gateway_id", scope, F.col("topic").alias("a"), F.col("new_name").alias("b"))
    used = edges.select(F.explode(F.array("a", "b")).alias("topic")).distinct()
    seen = _join(v.select("gateway_id", "file_no", "topic", "own_topic", "request_id", "event_no"), used, ["topic"], "left_semi").distinct()
    seen = seen.groupBy("gateway_id", "file_no", "topic", "own_topic").agg(F.count(F.lit(1)).alias("n"))
    in_file = seen.groupBy("gateway_id", "file_no").agg(F.collect_list(F.struct("topic", "n")).alias("all"))
    # two topics share as many events of a file as the rarer has there
    sets = in_file.select("gateway_id", scope, F.explode(F.array_distinct("all.n")).alias("at"), "all")
    lower = F.coalesce(F.array_max(F.filter("all.n", lambda n: n < F.col("at"))), F.lit(0))
    sets = sets.select("gateway_id", "scope", F.transform(F.filter("all", lambda x: x["n"] >= F.col("at")), lambda x: x["topic"]).alias("names"), (F.col("at") - lower).alias("n"))
    one_topic = materialize(one_names(edges, sets, seen.select("gateway_id", scope, F.col("own_topic").alias("a")), 2), "one-topics")
    one_topic = one_topic.where("name <> one_name").select(F.col("name").alias("own_topic"), F.col("one_name").alias("last_topic"))
    v = _join(v, one_topic, ["own_topic"], "left").withColumn("last_topic", F.coalesce("last_topic", "own_topic"))

    own = _join(report.where("change_kind = 'renamed'"), topics, ["gateway_id", "topic"], "left").withColumn("own_topic", F.coalesce("own_topic", "topic"))
    edges = _join(own, one_topic, ["own_topic"], "left").select("gateway_id", F.coalesce("last_topic", "own_topic").alias("scope"), F.col("field_path").alias("a"), F.col("new_name").alias("b"))
    used = edges.select(F.col("scope").alias("last_topic"), F.explode(F.array("a", "b")).alias("path")).distinct()
    seen = _join(v.select("gateway_id", "last_topic", "path", "own_path", "request_id", "event_no"), used, ["last_topic", "path"], "left_semi")
    sets = seen.groupBy("gateway_id", F.col("last_topic").alias("scope"), "request_id", "event_no").agg(F.sort_array(F.collect_set("path")).alias("names"))
    sets = sets.groupBy("gateway_id", "scope", "names").agg(F.count(F.lit(1)).alias("n"))
    one_path = one_names(edges, sets, seen.select("gateway_id", F.col("last_topic").alias("scope"), F.col("own_path").alias("a")), ONE_IN)
    one_path = materialize(one_path, "one-paths").where("name <> one_name").select(F.col("scope").alias("last_topic"), F.col("name").alias("own_path"), F.col("one_name").alias("last_path"))
    v = _join(v, one_path, ["last_topic", "own_path"], "left").withColumn("last_path", F.coalesce("last_path", "own_path")).drop("own_topic", "own_path")
    shown = v.groupBy("last_topic", "last_path", "kind").agg(F.count(F.lit(1)).alias("n"))
    one = shown.groupBy("last_topic", "last_path").agg(F.max_by("kind", F.struct("n", "kind")).alias("type"))
    v = _join(v, one, ["last_topic", "last_path"], "inner")
    ok = (
        F.when(F.col("type") == "number", F.col("value").rlike(DECIMAL) & (F.col("kind") != "boolean"))
        .when(F.col("type") == "boolean", F.lower("value").isin("true", "false"))
        .otherwise(F.lit(True))
    )
    return v.withColumn("castable", ok)


def cast_report(values: DataFrame) -> DataFrame:
    """Per topic and field: its type, how many values it has and how many failed the cast."""
    return values.groupBy(F.col("last_topic").alias("topic"), F.col("last_path").alias("field_path"), "type").agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if(~F.col("castable")).alias("n_failed"), F.count_if(F.col("kind") != F.col("type")).alias("n_other_type")
    )


def _names_in(values: DataFrame, topic: str, fields: list[str]) -> tuple[str, dict[str, str]]:
    """The names that a topic and its fields have in the consistent table; any name of a class will do."""

    def most(rows: list, wanted: str) -> str:
        own = [r for r in rows if r["name"] == wanted]
        return wanted if any(r["one"] == wanted for r in rows) or not own else max(own, key=lambda r: (r["n"], r["one"]))["one"]

    n = F.count(F.lit(1)).alias("n")
    top = most(values.where((F.col("topic") == topic) | (F.col("last_topic") == topic)).groupBy(F.col("topic").alias("name"), F.col("last_topic").alias("one")).agg(n).collect(), topic)
    mine = values.where((F.col("last_topic") == top) & (F.col("path").isin(fields) | F.col("last_path").isin(fields)))
    rows = mine.groupBy(F.col("path").alias("name"), F.col("last_path").alias("one")).agg(n).collect()
    return top, {f: most(rows, f) for f in fields}


def consistent_table(values: DataFrame, topic: str, fields: dict[str, str]) -> DataFrame:
    """One typed table of a topic: request_id, event_no, gateway_id, file_no and a column a field (arrays for repeated
    paths, in document order; values that fail the cast are null). fields: path -> type, from cast_report. Topic and
    fields may be named by any name of theirs; the columns have the names asked for."""
    topic, last_paths = _names_in(values, topic, list(fields))
    spark_type = {"number": "double", "boolean": "boolean", "string": "string"}
    aggs = []
    for path, kind in fields.items():
        typed = F.when(F.col("castable"), F.expr(f"try_cast(value as {spark_type[kind]})"))
        mine = F.col("last_path") == last_paths[path]
        name = re.sub(r"\W+", "_", path).strip("_")
        if "[]" in path:
            both = F.sort_array(F.collect_list(F.when(mine, F.struct("ordinal", typed.alias("v")))))
            aggs.append(F.transform(both, lambda x: x["v"]).alias(name))
        else:
            aggs.append(F.min(F.when(mine, typed)).alias(name))
    return values.where(F.col("last_topic") == topic).groupBy("request_id", "event_no", "gateway_id", "file_no").agg(*aggs)
