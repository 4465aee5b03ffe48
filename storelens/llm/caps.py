"""Operator 9: near-duplicate vectors by spherical-cap filters.

A filter direction is a product code: one of `CODES` random unit vectors in
each of `BLOCKS` blocks of coordinates, so `CODES ** BLOCKS` directions are
described by a few vectors. A vector is decoded to the list of all directions
whose inner product with it exceeds `CAP` (in units of a random direction's
standard deviation). Vectors meet where they share a filter; that finds nearly
all links. A vector is sure when its best filter lies so close that every vector
within the threshold must exceed it too (angles add up): all its links are found
there.

Neighbouring filters have many vectors in common, so a vector is sent once to
each family (a range of filters) with one of its own, and families are sent in
rounds that each take about the room of the vectors. A filter with more than
`CHUNK` vectors is cut into parts that do not meet here; its vectors are not sure.

An exact check follows for links between vectors that have not met, so none is
lost. Vectors that are not sure are dealt to the nearest of a few pivots, and
two cells are compared unless their radii prove that no member of one reaches a
member of the other. Where vectors point everywhere, as random ones in many
dimensions do, nothing is sure and no cell is ruled out; then the check is over
every pair, in matrix products. Time grows with the square of the rows there,
disk does not: each vector is written once, in a block, and tasks read the blocks
they compare from the checkpoint folder. Products of the directions in which the
vectors vary most, with a bound for the others, rule out most pairs. Up to 10
dimensions no filter can be exceeded and the check finds all.

A pair that shares several filters counts at the first one only, in the check
not at all. Tasks return sums and a spanning forest of their links instead of
pairs. Cosines are those of double precision.

Equal vectors are one class, counted as often as they occur. Vectors that are
null, zero, or hold null or non-finite components link with nothing, as do
vectors of different lengths. A row that repeats a vec_id is a row of its own;
the smallest id names a component.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import batches, checkpointed, lists, mixed, small_batches
from storelens.llm.components import connected_components

THRESHOLD = 0.9
BLOCKS = 2
CODES = 256
CAP = 3.2
# Rows of a filter that meet; a larger one is cut.
CHUNK = 16384
# Filters of a family, by the number of their entries.
FAMILY = 65536
# Bytes that a round sends, or as many as all components have where that is more.
ROUND_BYTES = 128 << 20
# Rows and bytes of a block of vectors that are compared without a filter, and most cells they are dealt to.
BLOCK_ROWS = 8192
BLOCK_BYTES = 4 << 20
CELLS = 512
# Bytes of the blocks of a side that a task compares.
SIDE_BYTES = 32 << 20
# Rows and columns of a matrix product.
STRIP = 256
# Vectors from which pivots and the directions of most variance are taken.
SAMPLE = 2048
# Angles (radians) are told apart beyond this.
SLACK = 1e-6
SEED = 9


@dataclass(frozen=True)
class Code:
    """The product code; `blocks` x `codes` unit vectors drawn for a dimension from a fixed seed."""

    blocks: int = BLOCKS
    codes: int = CODES
    cap: float = CAP

    def vectors(self, size: int) -> list[np.ndarray]:
        drawn = np.random.default_rng([SEED, size, self.blocks, self.codes])
        parts = [len(x) for x in np.array_split(np.arange(size), self.blocks)]
        made = [drawn.standard_normal((self.codes, n)) for n in parts]
        return [x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in made]

    def turn(self, size: int) -> np.ndarray:
        """A random rotation, so that every block sees an even share of a vector."""
        drawn = np.random.default_rng([SEED + 1, size])
        return np.linalg.qr(drawn.standard_normal((size, size)))[0]

    def decode(self, units: np.ndarray, vectors: list[np.ndarray], turn: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the sorted numbers of all filters it exceeds."""
        size = units.shape[1]
        turned = units @ turn
        ends = np.cumsum([0, *(v.shape[1] for v in vectors)])
        inner = [turned[:, a:b] @ v.T for v, a, b in zip(vectors, ends, ends[1:])]
        # A random direction of this form has inner products of this size with a random unit vector.
        cap = self.cap * np.sqrt(self.blocks / size)
        tops = np.array([x.max(1) for x in inner])
        rows, numbers, sums = np.arange(len(units)), np.zeros(len(units), np.int64), np.zeros(len(units))
        for k, x in enumerate(inner):
            reached = sums[:, None] + x[rows]
            i, j = np.nonzero(reached + tops[k + 1 :, rows].sum(0)[:, None] >= cap)
            rows, numbers, sums = rows[i], numbers[i] * self.codes + j, reached[i, j]
        return np.split(numbers, np.searchsorted(rows, np.arange(1, len(units))))[: len(units)]

    def sure(self, units: np.ndarray, vectors: list[np.ndarray], turn: np.ndarray, threshold: float) -> np.ndarray:
        """For each unit vector whether all vectors at this cosine or above exceed its best filter, and so does it."""
        turned = units @ turn
        ends = np.cumsum([0, *(v.shape[1] for v in vectors)])
        best, norm = np.zeros(len(units)), 0.0
        for v, a, b in zip(vectors, ends, ends[1:]):
            best += (turned[:, a:b] @ v.T).max(1)
            norm += float(b > a)
        angles = np.arccos(np.clip(best / np.sqrt(norm), -1, 1)) + np.arccos(np.clip(threshold, -1, 1)) + SLACK
        return np.sqrt(norm) * np.cos(np.minimum(angles, np.pi)) > self.cap * np.sqrt(self.blocks / units.shape[1])


def described(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """`key`, the name of the row's vector (null if it links with nothing) and its components as bytes.

    Single-precision components travel as such; they are exact in double precision.
    """
    single = dict(rows.dtypes)[vector] == "array<float>"
    kind = "<f4" if single else "<f8"

    def each():
        def step(part):
            column = part.column("_vector")
            ends = column.offsets.to_numpy()
            # Null components become not-a-number here.
            flat = column.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False).astype(kind, copy=False)
            ends = ends - ends[0]
            count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
            good = column.is_valid().to_numpy(zero_copy_only=False) & (count(flat != 0) > 0) & (count(~np.isfinite(flat)) == 0)
            raw = [flat[a:b].tobytes() if ok else None for a, b, ok in zip(ends, ends[1:], good)]
            yield {
                key: part.column(key),
                "name": [None if x is None else xxhash.xxh3_128_digest(x) for x in raw],
                "raw": raw,
            }

        return step

    vectors = F.col(vector) if single else F.col(vector).cast("array<double>")
    schema = f"`{key}` {dict(rows.dtypes)[key]}, name binary, raw binary"
    return batches(rows.select(key, vectors.alias("_vector")), schema, each)


def units_of(raws: list[bytes], single: bool) -> np.ndarray:
    """The unit vectors of rows of one length."""
    return _units(np.frombuffer(b"".join(raws), "<f4" if single else "<f8").reshape(len(raws), -1))


def _units(x: np.ndarray) -> np.ndarray:
    # Scaling by the largest component keeps the norm of very large and very small vectors exact.
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_size(sizes: list[int]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, size in enumerate(sizes):
        out.setdefault(size, []).append(i)
    return out


def filtered(classes: DataFrame, single: bool, code: Code, threshold: float) -> DataFrame:
    """Each class with the list of its filters, and whether it is sure to share one with each of its partners."""
    columns = ["name", "raw", "copies"]

    def each():
        known: dict[int, tuple] = {}

        def step(part):
            raws = part.column("raw").to_pylist()
            found: list = [None] * len(raws)
            sure = np.zeros(len(raws), bool)
            for own in _by_size(list(map(len, raws))).values():
                same = units_of([raws[i] for i in own], single)
                size = same.shape[1]
                if size not in known:
                    known[size] = (code.vectors(size), code.turn(size))
                sure[own] = code.sure(same, *known[size], threshold)
                for i, x in zip(own, code.decode(same, *known[size])):
                    found[i] = x
            yield {
                **{c: part.column(c) for c in columns},
                "sure": sure.tolist(),
                "filters": lists(np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int32), [len(x) for x in found], pa.int32()),
            }

        return step

    return batches(classes.select(*columns), "name binary, raw binary, copies long, sure boolean, filters array<int>", each)


class _Cut:
    """Into how many parts filters are cut that have more than `CHUNK` rows, and where entries go.

    An entry is a filter and the part of it that a row is in, as one number in the filter's order.
    """

    SPAN = 1 << 24

    def __init__(self, filters: np.ndarray, parts: np.ndarray):
        self.filters, self.parts = filters, parts

    def entries(self, filters: np.ndarray, lengths: np.ndarray, names: list[bytes]) -> np.ndarray:
        """The entries of rows, from all their filters one after another."""
        out = filters.astype(np.int64) * self.SPAN
        if len(self.filters):
            at = np.minimum(np.searchsorted(self.filters, filters), len(self.filters) - 1)
            cut = np.flatnonzero(self.filters[at] == filters)
            heads = np.frombuffer(b"".join(x[:8] for x in names), "<u8")
            with np.errstate(over="ignore"):
                drawn = mixed(np.repeat(heads, lengths)[cut] + filters[cut].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out[cut] += (drawn % self.parts[at[cut]].astype(np.uint64)).astype(np.int64)
        return out


def _listed(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, one after another, and the lengths of its lists."""
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def _forest(left: np.ndarray, right: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Links that connect what all given links connect.

    Each round joins every group that has a link to another one by one such link.
    """
    root = list(range(size))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    groups = np.arange(size)
    while len(left):
        first = np.unique(groups[left], return_index=True)[1]
        for i, j in zip(left[first].tolist(), right[first].tolist()):
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                kept.append((i, j))
        groups = np.array([find(i) for i in range(size)])
        apart = groups[left] != groups[right]
        left, right = left[apart], right[apart]
    return kept


def _share(filters: list, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each pair of rows whether their lists of filters have one in common."""
    out = np.zeros(len(left), bool)
    for start in range(0, len(left), 16384):
        some = slice(start, start + 16384)
        rows, places = np.unique(np.concatenate([left[some], right[some]]), return_inverse=True)
        a, b = np.split(places, 2)
        lengths = np.array([len(filters[i]) for i in rows])
        used, at = np.unique(np.concatenate([np.zeros(0, np.int64), *(filters[i] for i in rows)]), return_inverse=True)
        if len(rows) <= 2048 or not len(used):
            own = np.zeros((len(rows), len(used)), bool)
            own[np.repeat(np.arange(len(rows)), lengths), at] = True
            for k in range(0, len(a), 1024):
                out[start + k : start + k + 1024] = (own[a[k : k + 1024]] & own[b[k : k + 1024]]).any(1)
        else:
            # The lists of both rows of a pair one after another: what they have in common comes twice.
            ends = np.cumsum(lengths)
            both = np.column_stack([a, b]).ravel()
            n = lengths[both]
            value = at[np.arange(n.sum()) + np.repeat(ends[both] - np.cumsum(n), n)]
            value = np.sort(np.repeat(np.arange(len(both)) // 2, n) * len(used) + value)
            out[start + np.unique(value[1:][value[1:] == value[:-1]] // len(used))] = True
    return out


class _Found:
    """Rows (a, null, number of links of a) and (a, b, 0) of a link, as Arrow batches."""

    def __init__(self):
        self.rows = {"a": [], "b": [], "links": []}

    def add(self, a, b, links):
        for column, value in zip(self.rows.values(), (a, b, links)):
            column.append(value)

    def full(self):
        return len(self.rows["a"]) > 10_000

    def flush(self):
        kinds = {"a": pa.binary(), "b": pa.binary(), "links": pa.int64()}
        made = pa.RecordBatch.from_pydict({c: pa.array(x, kinds[c]) for c, x in self.rows.items()})
        for x in self.rows.values():
            x.clear()
        return made


class _Vectors:
    """Vectors of one length that are compared: in single precision, or by a bound in fewer directions (`basis`)."""

    def __init__(self, raw: bytes, size: int, single: bool, basis: np.ndarray | None = None):
        self.rows = np.frombuffer(raw, "<f4" if single else "<f8").reshape(-1, size // (4 if single else 8))
        units = _units(self.rows)
        if basis is None:
            self.narrow = units.astype(np.float32)
            return
        seen = units @ basis
        unseen = np.sqrt(np.maximum(0, 1 - (seen**2).sum(1)) + 1e-12)
        self.narrow = np.column_stack([seen, unseen]).astype(np.float32)

    def units(self, rows: np.ndarray | slice) -> np.ndarray:
        return _units(self.rows[rows])

    def only(self, rows: np.ndarray) -> _Vectors:
        out = object.__new__(_Vectors)
        out.rows, out.narrow = self.rows[rows], self.narrow[rows]
        return out


def _compared(a: _Vectors, b: _Vectors | None, threshold: float):
    """Index pairs of linked rows of two blocks, or of one (`b` None; then left < right), tile by tile.

    Single precision and the bound settle what their rounding leaves no doubt about.
    """
    other = a if b is None else b
    rounding = lambda x: (x.shape[1] + 8) * 2.0**-22
    bounded = a.narrow.shape[1] != a.rows.shape[1]
    # Tiles of a size share their arrays.
    room = np.empty(min(STRIP, len(a.rows)) * min(4 * STRIP, len(other.rows)), np.float32)
    flags = np.empty(len(room), bool)
    for start in range(0, len(a.rows), STRIP):
        for at in range(start if b is None else 0, len(other.rows), 4 * STRIP):
            own, met = a.narrow[start : start + STRIP], other.narrow[at : at + 4 * STRIP]
            shape, n = (len(own), len(met)), len(own) * len(met)
            cosine = np.matmul(own, met.T, out=room[:n].reshape(shape))
            near = np.greater_equal(cosine, threshold - rounding(a.narrow), out=flags[:n].reshape(shape))
            if b is None and at < start + STRIP:
                near &= np.arange(at, at + len(met)) > np.arange(start, start + len(own))[:, None]
            found = np.flatnonzero(near)
            if not len(found):
                continue
            whole = not bounded
            if bounded and len(found) > n // 64:
                # Many are near: whole vectors in single precision tell most of them.
                rows = [x.units(slice(k, k + m)).astype(np.float32) for x, k, m in ((a, start, len(own)), (other, at, len(met)))]
                np.matmul(rows[0], rows[1].T, out=cosine)
                near &= cosine >= threshold - rounding(a.rows)
                found, whole = np.flatnonzero(near), True
            open_ = np.flatnonzero(cosine.ravel()[found] < threshold + rounding(a.rows)) if whole else np.arange(len(found))
            left, right = found // len(met) + start, found % len(met) + at
            linked = np.ones(len(left), bool)
            for k in range(0, len(open_), 1024):
                some = open_[k : k + 1024]
                linked[some] = np.einsum("ij,ij->i", a.units(left[some]), other.units(right[some])) >= threshold
            if linked.any():
                yield left[linked], right[linked]


def _gathered(found):
    """Index pairs, about a million at a time."""
    held, n = [], 0
    for pairs in found:
        held.append(pairs)
        n += len(pairs[0])
        if n > 1_000_000:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def filters_linked(listed: DataFrame, single: bool, threshold: float) -> tuple[DataFrame, _Cut]:
    """Sums and links, as _Found, of classes that meet in a filter, and which filters are cut."""
    spark = listed.sparkSession
    sizes = listed.select(F.explode("filters").alias("filter")).groupBy("filter").agg(F.count(F.lit(1)).alias("size"))
    # At most one row for each filter of the code.
    sizes = sizes.where("size > 1").toArrow().sort_by("filter")
    filters, counts = sizes["filter"].to_numpy().astype(np.int64), sizes["size"].to_numpy()
    parts = -(-counts // CHUNK)
    cut = _Cut(filters[parts > 1], parts[parts > 1])
    schema = "a binary, b binary, links long"
    if not len(filters):
        return spark.createDataFrame([], schema), cut
    # Families are ranges of entries, about 256 of them or more.
    most = min(FAMILY, max(1024, int(counts.sum()) // 256))
    first = np.concatenate([[0], np.cumsum(parts)])[:-1]
    numbers = np.repeat(filters * _Cut.SPAN, parts) + np.arange(parts.sum()) - np.repeat(first, parts)
    held = np.repeat(counts / parts, parts)
    family = (np.cumsum(held) - held) // most
    starts = numbers[np.flatnonzero(np.diff(family, prepend=-1))]
    # The family of each filter that is not cut, -1 of one with a single row; beyond this a search tells.
    table = None
    if not len(cut.filters) and filters[-1] < 1 << 22:
        table = np.full(filters[-1] + 2, -1, np.int32)
        table[filters] = np.searchsorted(starts, filters * _Cut.SPAN, "right") - 1

    def dealt(part):
        """Of each row and family with an entry of the row: both and the place behind the entry; and the row's places."""
        flat, lengths = _listed(part.column("filters"))
        own = np.repeat(np.arange(len(lengths)), lengths)
        if table is not None:
            families = table[np.minimum(flat, len(table) - 1)]
        else:
            alone = filters[np.minimum(np.searchsorted(filters, flat), len(filters) - 1)] != flat
            entries = cut.entries(flat, lengths, part.column("name").to_pylist())
            families = np.where(alone, -1, np.searchsorted(starts, entries, "right") - 1)
        ends = np.flatnonzero(families >= 0) + 1
        own, families = own[ends - 1], families[ends - 1]
        last = np.flatnonzero((np.diff(own, append=-1) != 0) | (np.diff(families, append=-1) != 0))
        return own[last], families[last], ends[last], np.concatenate([[0], np.cumsum(lengths)]), flat

    def count():
        return lambda part: iter([{"family": dealt(part)[1]}])

    rows = batches(listed.select("name", "filters"), "family int", count).groupBy("family").agg(F.count(F.lit(1)).alias("n")).toArrow()
    sent = np.zeros(len(starts), np.int64)
    sent[rows["family"].to_numpy()] = rows["n"].to_numpy()
    room, widest = listed.agg(F.sum(F.length("raw")), F.avg(F.length("raw") + 2 * F.size("filters") + 64)).first()
    rounds = (np.cumsum(sent) - sent) * widest // max(room, ROUND_BYTES)
    columns = ["name", "raw", "copies"]

    def sender(low: int, high: int):
        def each():
            def step(part):
                own, families, ends, places, flat = dealt(part)
                here = (families >= low) & (families < high)
                own, families, ends = own[here], families[here], ends[here]
                lengths = ends - places[own]
                at = np.arange(lengths.sum()) + np.repeat(places[own] - np.cumsum(lengths) + lengths, lengths)
                yield {"family": families, **{c: part.column(c).take(pa.array(own)) for c in columns}, "filters": lists(flat[at], lengths.tolist(), pa.int32())}

            return step

        return each

    def meet(out: _Found, family: int, pieces: list[pa.RecordBatch]):
        part = pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
        names, raws, copies = part.column("name").to_pylist(), part.column("raw").to_pylist(), part.column("copies").to_numpy()
        flat, lengths = _listed(part.column("filters"))
        entries, ends = cut.entries(flat, lengths, names), np.concatenate([[0], np.cumsum(lengths)])
        start = starts[family]
        # Entries of the family are the last ones of a row.
        inside = entries >= start
        firsts = ends[1:] - np.diff(np.concatenate([[0], np.cumsum(inside)])[ends])
        numbers, rows_of = entries[inside], np.repeat(np.arange(len(lengths)), lengths)[inside]
        for rows in _by_size(list(map(len, raws))).values():
            vectors = _Vectors(b"".join(raws[i] for i in rows), len(raws[rows[0]]), single)
            rows = np.array(rows)
            here = np.isin(rows_of, rows)
            order = np.argsort(numbers[here], kind="stable")
            places = np.searchsorted(rows, rows_of[here][order])
            groups = [x for x in np.split(places, np.flatnonzero(np.diff(numbers[here][order])) + 1) if len(x) > 1]
            # All rows at once where that is less work than entry by entry, which costs about as much as 20,000 pairs besides.
            whole = len(rows) ** 2 <= sum(len(x) ** 2 + 20_000 for x in groups)
            found = []
            for group in [np.arange(len(rows))] if whole and groups else groups:
                for left, right in _compared(vectors if whole else vectors.only(group), None, threshold):
                    found.append(group[left] * len(rows) + group[right])
            if not found:
                continue
            found = np.unique(np.concatenate(found))
            used, both = np.unique(np.concatenate(np.divmod(found, len(rows))), return_inverse=True)
            left, right = np.split(both, 2)
            rows = rows[used].tolist()
            if whole:
                met = _share([entries[firsts[i] : ends[i + 1]] for i in rows], left, right)
                left, right = left[met], right[met]
            # Rows that share a smaller entry were met there.
            first = ~_share([entries[ends[i] : firsts[i]] for i in rows], left, right)
            left, right = left[first], right[first]
            links = np.zeros(len(rows), np.int64)
            np.add.at(links, left, copies[rows][right])
            np.add.at(links, right, copies[rows][left])
            for i in np.flatnonzero(links).tolist():
                out.add(names[rows[i]], None, int(links[i]))
            for i, j in _forest(left, right, len(rows)):
                out.add(names[rows[i]], names[rows[j]], 0)

    def run(parts):
        out = _Found()
        for family, pieces in _runs(parts, "family"):
            meet(out, family, pieces)
            if out.full():
                yield out.flush()
        yield out.flush()

    def sent_round(number: float) -> DataFrame:
        low, high = np.flatnonzero(rounds == number)[[0, -1]]
        met = batches(listed.select(*columns, "filters"), "family int, name binary, raw binary, copies long, filters array<int>", sender(int(low), int(high) + 1))
        # A family's rows come one after another; the order by name makes a rerun of a task give the same answer.
        return met.repartition("family").sortWithinPartitions("family", "name").mapInArrow(run, schema)

    # The files of a round's shuffle are gone before the next but one.
    return _united([checkpointed(sent_round(number)) for number in np.unique(rounds)]), cut


def _united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for other in frames[1:]:
        out = out.union(other)
    return out


def _runs(parts, column: str):
    """The values of a column that rows are sorted by, each with its rows in slices of batches."""
    value, held = None, []
    for part in parts:
        values = part.column(column).to_numpy()
        ends = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        for a, b in zip(ends, ends[1:]):
            if a < b:
                if held and value != values[a]:
                    yield value, held
                    held = []
                value = int(values[a])
                held.append(part.slice(a, b - a))
    if held:
        yield value, held


def not_sure(listed: DataFrame, cut: _Cut) -> DataFrame:
    """The classes that may have links to classes that they have not met."""
    if not len(cut.filters):
        return listed.where("not sure")

    def each():
        def step(part):
            flat, lengths = _listed(part.column("filters"))
            ends = np.concatenate([[0], np.cumsum(np.isin(flat, cut.filters))])[np.concatenate([[0], np.cumsum(lengths)])]
            kept = pa.array((np.diff(ends) > 0) | ~part.column("sure").to_numpy(zero_copy_only=False))
            part = part.filter(kept)
            yield {c: part.column(c) for c in part.schema.names}

        return step

    return batches(listed, "name binary, raw binary, copies long, sure boolean, filters array<int>", each)


def _basis(units: np.ndarray, threshold: float) -> np.ndarray | None:
    """The fewest directions in which a bound rules out nearly all pairs of a sample; None if whole vectors are as good."""
    size = units.shape[1]
    if size <= 512:
        axes = np.linalg.eigh(units.T @ units)[1][:, ::-1]
    else:
        axes = np.linalg.qr(np.random.default_rng([SEED + 2, size]).standard_normal((size, 64)))[0]
    units = units[:512]
    unlinked = np.triu(units @ units.T < threshold, 1)
    for width in (16, 24, 32, 48, 64):
        if width < size:
            seen = units @ axes[:, : width - 1]
            unseen = np.sqrt(np.maximum(0, 1 - (seen**2).sum(1)))
            if ((seen @ seen.T + np.outer(unseen, unseen) >= threshold) & unlinked).sum() <= unlinked.sum() / 16384:
                return np.ascontiguousarray(axes[:, : width - 1])
    return None


class _Block:
    """A packed block of rows, as `blocks_linked` writes it."""

    def __init__(self, size: int, names: bytes, copies: bytes, raws: bytes, lengths: bytes, filters: bytes, single: bool, basis: np.ndarray | None):
        self.names = names
        self.copies = np.frombuffer(copies, np.int64)
        self.ends = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.int32))])
        self.filters = np.frombuffer(filters, np.int32)
        self.vectors = _Vectors(raws, size, single, basis)

    def name(self, row: int) -> bytes:
        return self.names[16 * row : 16 * row + 16]

    def entries(self, rows: np.ndarray, cut: _Cut) -> list[np.ndarray]:
        own = [self.filters[self.ends[i] : self.ends[i + 1]] for i in rows]
        lengths = np.array(list(map(len, own)))
        return np.split(cut.entries(np.concatenate(own), lengths, [self.name(i) for i in rows]), np.cumsum(lengths)[:-1])


class _Sums:
    """Links of rows of several blocks, and a forest of links that connects what they connect."""

    def __init__(self):
        self.links: dict[int, np.ndarray] = {}
        self.names: dict[int, bytes] = {}
        self.root: dict[tuple, tuple] = {}
        self.kept: list[tuple] = []

    def find(self, x: tuple) -> tuple:
        root = self.root
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    def add(self, number: int, block: _Block, rows: np.ndarray, copies: np.ndarray):
        if number not in self.links:
            self.links[number], self.names[number] = np.zeros(len(block.copies), np.int64), block.names
        np.add.at(self.links[number], rows, copies)

    def connect(self, a: tuple, b: tuple):
        x, y = self.find(a), self.find(b)
        if x != y:
            self.root[x] = y
            self.kept.append((a, b))

    def flush(self):
        out = _Found()
        name = lambda x: self.names[x[0]][16 * x[1] : 16 * x[1] + 16]
        for number, links in self.links.items():
            for i in np.flatnonzero(links).tolist():
                out.add(name((number, i)), None, int(links[i]))
        for a, b in self.kept:
            out.add(name(a), name(b), 0)
        return out.flush()


def blocks_linked(rest: DataFrame, threshold: float, single: bool, cut: _Cut) -> DataFrame | None:
    """Sums and links, as _Found, of all pairs of these classes that have not met in a filter; None if there are none."""
    spark = rest.sparkSession
    rest = rest.select("name", "raw", "copies", "filters", F.length("raw").alias("size"))
    counts = {r["size"]: r["count"] for r in rest.groupBy("size").count().collect()}
    if not counts:
        return None
    most = {size: max(1, min(BLOCK_ROWS, BLOCK_BYTES // size)) for size in counts}
    wanted = {size: min(CELLS, math.ceil(n / most[size])) for size, n in counts.items()}
    share = F.lit(0.0)
    for size in [s for s, n in wanted.items() if n > 1]:
        drawn = max(wanted[size], min(SAMPLE, BLOCK_BYTES // size))
        share = F.when(F.col("size") == size, F.lit(drawn / counts[size])).otherwise(share)
    pivots: dict[int, np.ndarray] = {}
    bases: dict[int, np.ndarray | None] = {}
    if max(wanted.values()) > 1:
        drawn = rest.where(F.pmod(F.xxhash64(F.lit("pivot"), "name"), F.lit(1_000_000_000)) < share * 1_000_000_000)
        by_size: dict[int, list[tuple]] = {}
        for r in drawn.select("size", "raw", "name").collect():
            by_size.setdefault(r["size"], []).append((bytes(r["name"]), bytes(r["raw"])))
        for size, x in by_size.items():
            sample = units_of([raw for _, raw in sorted(x)], single)
            pivots[size], bases[size] = sample[: wanted[size]], _basis(sample, threshold)

    def deal():
        def step(part):
            sizes, raws = part.column("size").to_pylist(), part.column("raw").to_pylist()
            cells, angles = np.zeros(len(sizes), np.int32), np.full(len(sizes), np.pi)
            for size, own in _by_size(sizes).items():
                if size in pivots:
                    cosine = units_of([raws[i] for i in own], single) @ pivots[size].T
                    cells[own] = cosine.argmax(1)
                    angles[own] = np.arccos(np.clip(cosine.max(1), -1, 1))
            yield {**{c: part.column(c) for c in ("name", "raw", "copies", "filters", "size")}, "cell": cells, "angle": angles}

        return step

    dealt = batches(rest, "name binary, raw binary, copies long, filters array<int>, size int, cell int, angle double", deal)
    cells: dict[int, list[tuple]] = {}
    for r in dealt.groupBy("size", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect():
        cells.setdefault(r["size"], []).append((r["cell"], math.ceil(r["n"] / most[r["size"]]), r["radius"]))
    reach = math.acos(max(-1.0, min(1.0, threshold))) + SLACK
    # Blocks are numbered cell by cell; of each cell its first block and the first blocks of all cells it reaches.
    numbered, before = [], 0
    for size, own in sorted(cells.items()):
        firsts = before + np.concatenate([[0], np.cumsum([chunks for _, chunks, _ in own])])
        before = int(firsts[-1])
        between = np.arccos(np.clip(pivots[size] @ pivots[size].T, -1, 1)) if size in pivots else np.zeros((1, 1))
        places, radii = np.array([cell for cell, _, _ in own]), np.array([radius for _, _, radius in own])
        for k, (cell, chunks, radius) in enumerate(own):
            reached = np.flatnonzero(between[cell, places] <= radius + radii + reach)
            numbered.append((size, cell, chunks, int(firsts[k]), firsts[reached].tolist()))
    total = sum(n * (size + 160) for size, n in counts.items())
    sides = min(before, max(math.ceil(total / SIDE_BYTES), math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism))))
    rounds = min(sides, math.ceil(total / max(ROUND_BYTES, sum(n * size for size, n in counts.items()) // 2)))
    numbers = F.broadcast(spark.createDataFrame(numbered, "size int, cell int, chunks int, first int, reached array<int>"))
    block = dealt.join(numbers.drop("reached"), ["size", "cell"])
    block = block.withColumn("block", F.col("first") + F.pmod(F.xxhash64(F.lit("chunk"), "name"), F.col("chunks")).cast("int"))
    block = block.withColumn("side", F.col("block") % sides)
    block = block.select("block", "side", "first", "size", "name", "copies", "raw", "filters")
    packed = "block int, first int, size int, names binary, copies binary, raws binary, lengths binary, filters binary"

    def pack(parts):
        for number, pieces in _runs(parts, "block"):
            joined = lambda c: b"".join(x for p in pieces for x in p.column(c).to_pylist())
            flat, lengths = map(np.concatenate, zip(*(_listed(p.column("filters")) for p in pieces)))
            copies = np.concatenate([p.column("copies").to_numpy() for p in pieces])
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([number], pa.int32()),
                **{c: pa.array([pieces[0].column(c)[0].as_py()], pa.int32()) for c in ("first", "size")},
                **{c: pa.array([x], pa.binary()) for c, x in (("names", joined("name")), ("copies", copies.astype(np.int64).tobytes()), ("raws", joined("raw")), ("lengths", lengths.astype(np.int32).tobytes()), ("filters", flat.astype(np.int32).tobytes()))},
            })

    def packed_round(number: int) -> DataFrame:
        low, high = sides * number // rounds, sides * (number + 1) // rounds
        some = block.where((F.col("side") >= low) & (F.col("side") < high))
        return some.repartitionById(high - low, F.col("side") - low).sortWithinPartitions("block", "name").mapInArrow(pack, packed)

    small_batches(spark)
    blocks = _united([checkpointed(packed_round(number)) for number in range(rounds)])
    blocks = blocks.join(numbers.select("first", "reached"), "first")
    left, right = (blocks.select(*(F.col(c).alias(f"{side}_{c}") for c in blocks.columns)) for side in "ab")
    # Of two blocks one is left, the other right, so that each task has half of its pairs.
    once = (F.col("a_block") < F.col("b_block")) == ((F.col("a_block") + F.col("b_block")) % 2 == 1)
    meeting = F.array_contains("a_reached", F.col("b_first")) & ((F.col("a_block") == F.col("b_block")) | once)
    met = left.join(right.drop("b_reached").hint("shuffle_replicate_nl"), meeting).drop("a_reached")

    def compare(sums: _Sums, a: int, b: int, known: dict[int, _Block]):
        x, y = known[a], known[b]
        for left, right in _gathered(_compared(x.vectors, None if a == b else y.vectors, threshold)):
            # Rows that share an entry were met there.
            rows = [np.unique(left), np.unique(right)]
            places = np.searchsorted(rows[0], left), np.searchsorted(rows[1], right) + len(rows[0])
            apart = ~_share([*x.entries(rows[0], cut), *y.entries(rows[1], cut)], *places)
            if apart.any():
                sums.add(a, x, left[apart], y.copies[right[apart]])
                sums.add(b, y, right[apart], x.copies[left[apart]])
                both = [*((a, i) for i in rows[0].tolist()), *((b, i) for i in rows[1].tolist())]
                for i, j in _forest(places[0][apart], places[1][apart], len(both)):
                    sums.connect(both[i], both[j])

    def run(parts):
        sums = _Sums()
        known: dict[int, _Block] = {}
        for part in parts:
            sides_ = [part.column(f"{side}_block").to_pylist() for side in "ab"]
            for row, numbers in enumerate(zip(*sides_)):
                for side, number in zip("ab", numbers):
                    if number not in known:
                        # A task has blocks of two sides; these are all kept unless their rows are very wide.
                        if sum(x.vectors.rows.nbytes for x in known.values()) > 4 * SIDE_BYTES:
                            known = {k: x for k, x in known.items() if k in numbers}
                        size, *fields = (part.column(f"{side}_{c}")[row].as_py() for c in ("size", "names", "copies", "raws", "lengths", "filters"))
                        known[number] = _Block(size, *fields, single, bases.get(size))
                compare(sums, *numbers, known)
        yield sums.flush()

    return met.mapInArrow(run, "a binary, b binary, links long")


def near_duplicates(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", code: Code = Code(), threshold: float = THRESHOLD
) -> DataFrame:
    """`key`, `n_links`, `component_id` and `kept` for every row."""
    single = dict(rows.dtypes)[vector] == "array<float>"
    named = checkpointed(described(rows.select(key, vector), key, vector))
    classes = checkpointed(
        named.where("name is not null").groupBy("name").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw"))
    )
    # Components are kept once at a time: files of earlier steps go when nothing needs them.
    named = checkpointed(named.select(key, "name"))
    listed = checkpointed(filtered(classes, single, code, threshold))
    classes = checkpointed(classes.select("name", "first", "copies"))
    found, cut = filters_linked(listed, single, threshold)
    rest = blocks_linked(not_sure(listed, cut), threshold, single, cut)
    del listed
    found = checkpointed(found.union(rest) if rest is not None else found)
    sums = found.where("b is null").groupBy(F.col("a").alias("name")).agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("b is not null").select("a", "b"))
    answer = classes.join(sums, "name", "left").join(groups.withColumnRenamed("node", "name"), "name", "left")
    answer = checkpointed(answer.select("name", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "name").alias("root")))
    smallest = answer.groupBy("root").agg(F.min("first").alias("_component"))
    answer = answer.join(smallest, "root").select("name", "n_links", "_component")
    done = named.select(key, "name").join(answer, "name", "left")
    component = F.coalesce("_component", key)
    return done.select(
        key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"),
        F.coalesce(component == F.col(key), F.lit(False)).alias("kept"),
    )
