"""Numpy helpers that run inside Spark tasks on one bounded block of rows.

Spark decides which rows meet (scan batches, or blocks of a bucket); these
helpers only score one block of catalog rows against one block of queries and
keep the best few. Self-contained, because the module is pickled by value.
"""

import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Scores (between -1 and 1) are compared as whole multiples of 1e-9, so that sum order never decides a rank.
SCORE_UNIT = 1e9
# Score of a pair that is not compared.
HIDDEN = -2.0
# Sides of the score matrix held at a time: small enough to stay in the processor's cache.
TILE = 1024
# An item that fills more than this share of a block's pairs is counted by matrix product.
DENSE_SHARE = 1 / 128


def column(table, name):
    col = table.column(name)
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def id_rank(ids):
    """Place of each id in the order of ids, equal for equal ids."""
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    return pc.rank(ids, "ascending", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64) - 1


def matrix(vectors):
    """Rows x positions, from list arrays or sparse (size, indices, values) structs."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    if pa.types.is_struct(vectors.type):
        size, indices, values = (pc.struct_field(vectors, f) for f in ("size", "indices", "values"))
        sizes = pc.unique(size).to_pylist()
        if len(sizes) > 1:
            raise ValueError(f"vectors of different length: {sorted(sizes)[:2]}")
        out = np.zeros((n, sizes[0] if sizes else 0))
        if n:
            out[
                pc.list_parent_indices(indices).to_numpy(zero_copy_only=False),
                pc.list_flatten(indices).to_numpy(zero_copy_only=False),
            ] = pc.list_flatten(values).to_numpy(zero_copy_only=False)
        return out
    lengths = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if len(lengths) > 1:
        raise ValueError(f"vectors of different length: {lengths[:2]}")
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, lengths[0] if lengths else 0)


def unit_rows(m):
    norm = np.sqrt((m * m).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return m / norm[:, None], norm > 0


def flat_indices(vectors):
    return pc.list_flatten(pc.struct_field(vectors, "indices")).to_numpy(zero_copy_only=False)


def unit_matrix(vectors, positions):
    """Vectors of length 1 at some positions (all, for dense vectors), and which have a length."""
    if positions is None:
        return unit_rows(matrix(vectors))
    size, indices, values = (pc.struct_field(vectors, f) for f in ("size", "indices", "values"))
    if len(pc.unique(size)) > 1:
        raise ValueError(f"vectors of different length: {sorted(pc.unique(size).to_pylist())[:2]}")
    row = pc.list_parent_indices(indices).to_numpy(zero_copy_only=False)
    at, value = flat_indices(vectors), pc.list_flatten(values).to_numpy(zero_copy_only=False)
    norm = np.sqrt(np.bincount(row, value * value, len(vectors)))
    place = np.minimum(np.searchsorted(positions, at), max(len(positions) - 1, 0))
    used = positions[place] == at if len(positions) else np.zeros(len(at), bool)
    out = np.zeros((len(vectors), len(positions)))
    out[row[used], place[used]] = value[used]
    with np.errstate(divide="ignore", invalid="ignore"):
        return out / norm[:, None], norm > 0


def plane_matrix(count, length, seed):
    def sign(k, d):
        return 1.0 if hashlib.md5(f"{seed}{k}:{d}".encode()).hexdigest()[0] >= "8" else -1.0

    return np.array([[sign(k, d) for d in range(length)] for k in range(count)]).reshape(count, length)


def plane_sides(count, seed):
    """For an Arrow UDF: -1, 0 or +1 per plane; the planes are built once per task."""
    known = {}

    def sides(vectors: pa.Array) -> pa.Array:
        m = matrix(vectors)
        if m.shape[1] not in known:
            known[m.shape[1]] = plane_matrix(count, m.shape[1], seed)
        side = np.sign(m @ known[m.shape[1]].T).astype(np.int8)
        return pa.FixedSizeListArray.from_arrays(pa.array(side.ravel()), count).cast(pa.list_(pa.int8()))

    return sides


# Queries whose probes are held at a time.
PROBE_ROWS = 128


def probe_adder(count, bands, seed, most):
    """For ``mapInArrow`` on rows with ``vector`` and ``band_keys``: adds ``probes``, the ``most`` buckets to look into, nearest first.

    A bucket is the query's own key with some planes' sides flipped; it is as far as
    the query lies from these planes, taken together. Goes on a few queries at a time.
    """
    length = -(-count // bands)

    def run(batches):
        known = {}
        for whole in batches:
            for start in range(0, whole.num_rows, PROBE_ROWS):
                batch = whole.slice(start, PROBE_ROWS)
                m = matrix(batch.column("vector"))
                if m.shape[1] not in known:
                    known[m.shape[1]] = plane_matrix(count, m.shape[1], seed)
                far = np.abs(m @ known[m.shape[1]].T)
                found = all_nearest_flips(far, batch.column("band_keys").to_pylist(), length, most)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = np.concatenate([np.zeros((0, 2), np.int64), *found])
                pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0].astype(np.int32)), pa.array(flat[:, 1])], ["band", "key"])
                yield batch.append_column("probes", pa.ListArray.from_arrays(pa.array(ends), pairs))

    return run


# Buckets of a query that are all put in order, for each one wanted; where there are more, they are found one after the other.
FLIPS_SORTED = 16


def all_nearest_flips(far, own, length, most):
    """``nearest_flips`` of some queries, each as an array; all buckets of a query are sorted at once if they are few.

    Their distances are summed in the order in which ``nearest_flips`` sums them. Queries with buckets equally far are
    left to it.
    """
    starts = range(0, far.shape[1], length)
    few = length < 32 and sum(1 << min(length, far.shape[1] - start) for start in starts) <= FLIPS_SORTED * most
    if not few or most <= len(starts) or any(keys is None or len(keys) != len(starts) for keys in own):
        return [np.array(nearest_flips(d, keys, length, most), np.int64).reshape(-1, 2) for d, keys in zip(far, own, strict=True)]
    costs, keys, bands = [], [], []
    for band, start in enumerate(starts):
        part = far[:, start : start + length]
        planes = np.argsort(part, axis=1, kind="stable")
        near = np.take_along_axis(part, planes, axis=1)
        cost, key = np.zeros((len(far), 1)), np.array([k[band] for k in own], np.int64)[:, None]
        for i in range(part.shape[1]):
            bit = np.int64(1) << (part.shape[1] - 1 - planes[:, i]).astype(np.int64)
            cost, key = np.hstack([cost, cost + near[:, i : i + 1]]), np.hstack([key, key ^ bit[:, None]])
        costs.append(cost)
        keys.append(key)
        bands.append(np.full(cost.shape[1], band))
    costs, keys, bands = np.hstack(costs), np.hstack(keys), np.concatenate(bands)
    order = np.argsort(costs, axis=1)[:, : most + 1]
    # the own buckets of all bands come first, equally far
    own_first = order[:, : len(starts)]
    own_first.sort(axis=1)
    far_apart = np.diff(np.take_along_axis(costs, order[:, len(starts) - 1 :], axis=1), axis=1) > 0
    sure = far_apart.all(axis=1) & (np.take_along_axis(costs, own_first, axis=1) == 0).all(axis=1)
    order = order[:, :most]
    return [
        np.stack([bands[at], k[at]], axis=1) if ok else np.array(nearest_flips(d, theirs, length, most), np.int64).reshape(-1, 2)
        for at, k, ok, d, theirs in zip(order, keys, sure, far, own, strict=True)
    ]


def nearest_flips(far, own, length, most):
    """The keys (band, key) in ascending order of the sum of the flipped planes' distances, ties by band and key."""
    bands = []
    for start in range(0, len(far), length):
        part = far[start : start + length]
        planes = np.argsort(part, kind="stable")
        bands.append((part[planes].tolist(), [1 << (len(part) - 1 - int(p)) for p in planes]))
    heap = [(0.0, band, key, -1, 0.0) for band, key in enumerate(own)]
    heapq.heapify(heap)
    out = []
    while heap and len(out) < most:
        cost, band, key, last, before = heapq.heappop(heap)
        out.append((band, key))
        near, bit = bands[band]
        if last + 1 < len(near):
            # one more plane, or the next plane in place of the last one
            more = cost + near[last + 1]
            heapq.heappush(heap, (more, band, key ^ bit[last + 1], last + 1, cost))
            if last >= 0:
                heapq.heappush(heap, (before + near[last + 1], band, key ^ bit[last] ^ bit[last + 1], last + 1, before))
    return out


# --- scorers: (queries, catalog rows) -> matrix of scores, HIDDEN where a pair is not compared ---


class CosineScorer:
    def __init__(self, exclude_self=True, null_is_self=False):
        """``null_is_self``: a row without an id is the own row of a query without one."""
        self.exclude_self, self.null_is_self = exclude_self, null_is_self

    def prepare(self, queries):
        vectors = column(queries, "vector")
        # of sparse vectors only the positions that some query uses matter
        self.positions = np.unique(flat_indices(vectors)) if pa.types.is_struct(vectors.type) else None
        unit, ok = unit_matrix(vectors, self.positions)
        return {"unit": unit, "ok": ok, "qid": column(queries, "qid")}

    def prepare_rows(self, rows):
        unit, ok = unit_matrix(column(rows, "vector"), self.positions)
        return {"unit": unit, "ok": ok, "id": column(rows, "id")}

    def score(self, queries, pick, rows):
        out = queries["unit"][pick] @ rows["unit"].T
        out[~queries["ok"][pick], :] = HIDDEN
        out[:, ~rows["ok"]] = HIDDEN
        if self.exclude_self:
            theirs = queries["qid"].take(pa.array(pick))
            hide_equal(out, theirs, rows["id"])
            if self.null_is_self and theirs.null_count and rows["id"].null_count:
                out[np.ix_(*[np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False)) for ids in (theirs, rows["id"])])] = HIDDEN
        return out


class MembershipScorer:
    """Every pair counts the same: the order is by id alone."""

    def __init__(self, exclude_self=True):
        self.exclude_self = exclude_self

    def prepare(self, queries):
        return {"qid": column(queries, "qid")}

    def prepare_rows(self, rows):
        return {"id": column(rows, "id")}

    def score(self, queries, pick, rows):
        out = np.zeros((len(pick), len(rows["id"])))
        if self.exclude_self:
            hide_equal(out, queries["qid"].take(pa.array(pick)), rows["id"])
        return out


class AttributeScorer:
    LISTS = ("genres", "writers", "directors")

    def __init__(self, weights, overlap, missing, several_names=False):
        """``several_names``: a catalog row without a name stands for titles of several names."""
        self.weights, self.overlap, self.missing, self.several_names = weights, overlap, missing, several_names

    def prepare(self, table):
        values, at = np.unique(numbers(table), axis=0, return_inverse=True)
        lists = {name: countable(column(table, name), self.missing) for name in self.LISTS}
        for name in self.LISTS:
            # a list may hold a part of the items only; its whole length is then beside it
            if f"{name}_size" in table.column_names:
                lists[name]["size"] = column(table, f"{name}_size").to_numpy(zero_copy_only=False).astype(np.int64)
        return {"title": column(table, "title"), "values": values, "at": at.ravel(), **lists}

    prepare_rows = prepare

    def score(self, queries, pick, rows):
        w = self.weights
        # flag and runtime take few distinct values: score those, then spread them over the pairs
        a, b = queries["values"][:, None, :], rows["values"][None, :, :]
        table = w["flag"] * (a[..., 0] == b[..., 0])
        table = table + w["runtime"] * (1.0 - np.abs(a[..., 1] - b[..., 1]) / (a[..., 1] + b[..., 1] + 0.01))
        out = table[queries["at"][pick]].take(rows["at"], axis=1)
        for name in self.LISTS:
            add_overlap(out, w[name], queries[name], pick, rows[name], self.overlap)
        out /= w["total"]
        titles = queries["title"].take(pa.array(pick))
        hide_equal(out, titles, rows["title"])
        # a title without a name is never compared
        out[~titles.is_valid().to_numpy(zero_copy_only=False), :] = HIDDEN
        if not self.several_names:
            out[:, ~rows["title"].is_valid().to_numpy(zero_copy_only=False)] = HIDDEN
        return out


def numbers(table):
    """Flag and runtime; a missing flag is its own value, a missing runtime is 0 minutes."""
    flag, runtime = (
        column(table, name).cast(pa.float64()).to_numpy(zero_copy_only=False) for name in ("flag", "runtime")
    )
    return np.stack([flag, np.nan_to_num(runtime)], axis=1)


def hide_equal(out, theirs, own):
    """Hide the pairs whose values are equal."""
    known = pc.unique(theirs).drop_null()
    code_q, code_c = codes(theirs, known), codes(own, known)
    q, c = np.flatnonzero(code_q >= 0), np.flatnonzero(code_c >= 0)
    out[meetings(q, code_q[q], c, code_c[c])] = HIDDEN


def codes(values, known):
    """Place of each value in ``known``, -1 where it is not there."""
    if values.type != known.type:
        values = values.cast(known.type)
    return pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy(zero_copy_only=False)


def meetings(q, q_key, c, c_key):
    """All (q, c) whose keys are equal: a merge of the two sides."""
    order = np.argsort(c_key, kind="stable")
    c, c_key = c[order], c_key[order]
    start, stop = np.searchsorted(c_key, q_key, side="left"), np.searchsorted(c_key, q_key, side="right")
    count = stop - start
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(q, count), c[np.repeat(start, count) + inside]


def countable(lists, missing):
    """(row, item, nth repeat) of every item, and the list sizes; a list with the missing mark counts as empty."""
    n = len(lists)
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    item = pc.list_flatten(lists)
    bad = np.zeros(n, dtype=bool)
    bad[row[pc.fill_null(pc.equal(item, missing), False).to_numpy(zero_copy_only=False)]] = True
    keep = ~bad[row]
    row, item = row[keep], item.filter(pa.array(keep))
    size = np.bincount(row, minlength=n) if len(row) else np.zeros(n, dtype=np.int64)
    code = item.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    # nth repeat of an item in its list: position inside the run of equal (row, code)
    order = np.lexsort((code, row))
    r, c = row[order], code[order]
    start = np.ones(len(r), dtype=bool)
    start[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
    first = np.maximum.accumulate(np.where(start, np.arange(len(r)), 0)) if len(r) else np.zeros(0, dtype=np.int64)
    return {"row": r, "item": item.take(pa.array(order)), "nth": np.arange(len(r)) - first, "size": size}


def add_overlap(out, weight, q, pick, c, mode):
    """Add ``weight`` x shared items (with repeats) over the longer list.

    Rare items touch only the pairs that share them; an item that many pairs
    share becomes a column of a 0/1 matrix product.
    """
    place = np.full(len(q["size"]), -1)
    place[pick] = np.arange(len(pick))
    mine = place[q["row"]] >= 0
    q_row, q_nth, q_item = place[q["row"]][mine], q["nth"][mine], q["item"].filter(pa.array(mine))
    known = pc.unique(q_item)
    q_code, c_code = codes(q_item, known).astype(np.int64), codes(c["item"], known).astype(np.int64)
    hit = c_code >= 0
    c_row, c_nth, c_code = c["row"][hit], c["nth"][hit], c_code[hit]
    repeats = 1 + max(q_nth.max(initial=0), c_nth.max(initial=0))
    q_key, c_key = q_code * repeats + q_nth, c_code * repeats + c_nth
    pairs = np.bincount(q_key, minlength=len(known) * repeats) * np.bincount(c_key, minlength=len(known) * repeats)
    dense = np.flatnonzero(pairs > DENSE_SHARE * out.size)
    q_rare, c_rare = ~np.isin(q_key, dense), ~np.isin(c_key, dense)
    rows, cols = meetings(q_row[q_rare], q_key[q_rare], c_row[c_rare], c_key[c_rare])
    size_q, size_c = q["size"][pick], c["size"]
    if len(dense):
        left = np.zeros((len(size_q), len(dense)), dtype=np.float32)
        right = np.zeros((len(size_c), len(dense)), dtype=np.float32)
        left[q_row[~q_rare], np.searchsorted(dense, q_key[~q_rare])] = 1.0
        right[c_row[~c_rare], np.searchsorted(dense, c_key[~c_rare])] = 1.0
        common = (left @ right.T).astype(np.float64)
        np.add.at(common, (rows, cols), 1.0)
        rows, cols = slice(None), slice(None)
        size_q, size_c = size_q[:, None], size_c[None, :]
    else:
        cell, common = np.unique(rows * len(size_c) + cols, return_counts=True)
        rows, cols = cell // max(len(size_c), 1), cell % max(len(size_c), 1)
        size_q, size_c = size_q[rows], size_c[cols]
    if mode == "exact":
        value = ((common == size_q) & (common == size_c) & (common > 0)).astype(np.float64)
    else:
        value = common / np.maximum(np.maximum(size_q, size_c), 1)
    out[rows, cols] += weight * value


# --- keeping the k best per query ---


class Best:
    """Running k best catalog rows per query, in (score desc, id) or (id desc) order."""

    def __init__(self, queries, scorer, k, carry, id_desc=False):
        self.scorer, self.k, self.carry, self.id_desc = scorer, k, carry, id_desc
        self.qid = column(queries, "qid")
        self.prepared = scorer.prepare(queries)
        self.floor = np.full(len(self.qid), -np.inf)
        self.parts, self.held = [], 0

    def add(self, rows):
        """Score a block of catalog rows against all queries."""
        pick = np.arange(len(self.qid))
        for start in range(0, rows.num_rows, TILE):
            piece = rows.slice(start, TILE)
            if self.id_desc:
                # one more than k, because a query's own row may be among them
                last = np.argsort(id_rank(piece.column("id")))[::-1][: self.k + 1]
                piece = piece.take(pa.array(last))
            # greatest for the id that wins a tie
            rank = id_rank(piece.column("id"))
            place = rank if self.id_desc else len(rank) - 1 - rank
            prepared = self.scorer.prepare_rows(piece)
            for first in range(0, len(pick), TILE):
                self.add_tile(piece, prepared, place, pick[first : first + TILE])

    def add_tile(self, piece, prepared, place, pick):
        n = len(place)
        both = self.scorer.score(self.prepared, pick, prepared)
        least = np.maximum(self.floor[pick], HIDDEN * SCORE_UNIT / 2)
        # what may round to the least score at most
        near = both >= ((least - 1) / SCORE_UNIT)[:, None]
        if n > self.k and np.count_nonzero(near) > 2 * self.k * len(pick):
            # score and id in one whole number: no ties, so exactly k per query can stay
            both *= SCORE_UNIT
            np.rint(both, out=both)
            both *= n
            both += place
            keep = both >= (least * n)[:, None]
            if np.count_nonzero(keep) > 2 * self.k * len(pick):
                keep &= both >= np.partition(both, n - self.k, axis=1)[:, n - self.k][:, None]
            q, r = np.nonzero(keep)
            score = np.floor_divide(both[q, r], n)
        else:
            q, r = np.divmod(np.flatnonzero(near), n)
            score = np.rint(both[q, r] * SCORE_UNIT)
            keep = score >= least[q]
            q, r, score = q[keep], r[keep], score[keep]
        if not len(q):
            return
        self.parts.append((pick[q], score, piece.select(["id", *self.carry]).take(pa.array(r))))
        self.held += len(q)
        unset = n > self.k and self.floor[pick].min() == -np.inf
        if unset or self.held > 4 * self.k * len(self.qid) + 100_000:
            self.prune()

    def prune(self):
        """Cut to the k best per query. A repeated row counts once."""
        q = np.concatenate([p[0] for p in self.parts])
        score = np.concatenate([p[1] for p in self.parts])
        rows = pa.concat_tables([p[2] for p in self.parts])
        rank = id_rank(rows.column("id"))
        order = np.lexsort((-rank if self.id_desc else rank, -score, q))
        oq, orank = q[order], rank[order]
        again = np.zeros(len(oq), dtype=bool)
        again[1:] = (oq[1:] == oq[:-1]) & (orank[1:] == orank[:-1])
        order, oq = order[~again], oq[~again]
        first = np.searchsorted(oq, oq, side="left")
        nth = np.arange(len(oq)) - first
        full = oq[nth == self.k - 1]
        self.floor[full] = score[order[nth == self.k - 1]]
        order = order[nth < self.k]
        self.parts = [(q[order], score[order], rows.take(pa.array(order)))]
        self.held = len(order)

    def table(self):
        if not self.parts:
            return None
        self.prune()
        q, score, rows = self.parts[0]
        return pa.table(
            {
                "qid": self.qid.take(pa.array(q)),
                "score": pa.array(score / SCORE_UNIT),
                **{name: rows.column(name) for name in rows.column_names},
            }
        )


def scan_scorer(queries, scorer, k, carry, id_desc=False):
    """For ``mapInArrow``: every task scores its catalog rows against the whole query batch."""

    def run(batches):
        best = Best(queries, scorer, k, carry, id_desc) if queries.num_rows else None
        for batch in batches:
            if best is not None and batch.num_rows:
                best.add(pa.Table.from_batches([batch]))
        out = best.table() if best is not None else None
        if out is not None:
            yield from out.select(["qid", "id", "score", *carry]).to_batches()

    return run


def block_scorer(schema, scorer, k, carry, id_desc=False, catalog_block=None, query_block=None):
    """For a cogrouped ``applyInArrow``: catalog rows against queries, all at once or in blocks of these sides."""

    def run(catalog, queries):
        found = []
        step, side = query_block or queries.num_rows, catalog_block or catalog.num_rows
        for start in range(0, queries.num_rows if catalog.num_rows else 0, step):
            best = Best(queries.slice(start, step), scorer, k, carry, id_desc)
            for first in range(0, catalog.num_rows, side):
                best.add(catalog.slice(first, side))
            out = best.table()
            if out is not None:
                found.append(out.select(["qid", "id", "score", *carry]).cast(schema))
        return pa.concat_tables(found) if found else schema.empty_table()

    return run


# Queries of a cell that are held with their k best at a time.
CELL_QUERIES = 4096


def cell_scorer(schema, scorer, k, carry, bucket):
    """For a cogrouped ``applyInArrow``: the catalog rows of a cell against its queries, where both name the same bucket.

    A cell is a hash, so that two buckets may share one.
    """

    def run(catalog, queries):
        found = []
        for key in queries.select(bucket).group_by(bucket).aggregate([]).to_pylist() if catalog.num_rows else []:
            own, theirs = (t.filter(pc.and_(*[pc.equal(t.column(n), key[n]) for n in bucket])) for t in (catalog, queries))
            for start in range(0, theirs.num_rows if own.num_rows else 0, CELL_QUERIES):
                best = Best(theirs.slice(start, CELL_QUERIES), scorer, k, carry)
                best.add(own)
                out = best.table()
                if out is not None:
                    found.append(out.select(["qid", "id", "score", *carry]).cast(schema))
        return pa.concat_tables(found) if found else schema.empty_table()

    return run


# Queries whose kept buckets are the bits of one number.
MASK_QUERIES = 64


def bucket_pairs(schema, marks, counts=False):
    """For a cogrouped ``applyInArrow``: the pairs of catalog rows and queries that share a kept bucket, each once.

    ``marks``, if given, is a list column of the queries; ``marked`` is how often the row's id stands in it. With ``counts``
    each query that meets a row gives the sum of ``marked`` over its pairs, ``hits``, and ``met``, the pairs, of which a
    marked one counts as often as it is marked.
    """

    def run(catalog, queries):
        if not catalog.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids, own = column(catalog, "id"), column(catalog, "band_keys")
        keys = pc.list_flatten(own).to_numpy(zero_copy_only=False).reshape(len(own), -1)
        bands = [np.unique(keys[:, b], return_inverse=True) for b in range(keys.shape[1])]
        kept = column(queries, "kept")
        looked = [[] for _ in bands]
        asker, flat = pc.list_parent_indices(kept).to_numpy(zero_copy_only=False), pc.list_flatten(kept)
        band, key = (pc.struct_field(flat, n).to_numpy(zero_copy_only=False) for n in ("band", "key"))
        for b, (names, _) in enumerate(bands):
            mine = np.flatnonzero(band == b)
            place = np.minimum(np.searchsorted(names, key[mine]), len(names) - 1)
            hit = names[place] == key[mine]
            looked[b] = asker[mine][hit], place[hit]
        listed = None if marks is None else marked_rows(ids, column(queries, marks))
        at, rows, marked, out = [], [], [], []
        for q, times in meetings_of(bands, looked, len(kept), len(ids)):
            if listed is not None:
                row, n = (x[listed[0][q] : listed[0][q + 1]] for x in listed[1:])
            if counts:
                met = times[row].astype(np.int64)
                whole = np.count_nonzero(times) if times.dtype == bool else times.sum(dtype=np.int64)
                out.append((q, (met * n).sum(), whole + (met * (n - 1)).sum()))
                continue
            found = np.flatnonzero(times)
            if len(found) and times.dtype != bool and times.max() > 1:
                found = np.repeat(found, times[found])
            at.append(np.full(len(found), q))
            rows.append(found)
            if listed is not None:
                full = np.zeros(len(ids), dtype=np.int64)
                full[row] = n
                marked.append(full[found])
        qid = column(queries, "qid")
        if counts:
            q, hits, met = np.array(out, np.int64).reshape(-1, 3)[[x[2] > 0 for x in out]].T
            return pa.table({"qid": qid.take(pa.array(q)), "hits": pa.array(hits), "met": pa.array(met)}).cast(schema)
        out = {"qid": qid.take(pa.array(np.concatenate(at))), "cand_id": ids.take(pa.array(np.concatenate(rows)))}
        if marks is not None:
            out["marked"] = pa.array(np.concatenate(marked))
        return pa.table(out).cast(schema)

    return run


def meetings_of(bands, looked, n_queries, n_rows):
    """``(query, times)`` in order: how often each row is met, for which the first band counts in which it is; whether, if no bucket is listed twice.

    ``looked`` has the queries and the places of their buckets for each band. Some queries at a time are the bits of
    one number, so that a row finds in which buckets of a band it stands by one look for all of them.
    """
    twice = any(len(np.unique(q * len(names) + place)) < len(q) for (names, _), (q, place) in zip(bands, looked, strict=True))
    for start in range(0, n_queries, MASK_QUERIES):
        stop = min(start + MASK_QUERIES, n_queries)
        parts = [(q[i], place[i]) for q, place in looked for i in [slice(*np.searchsorted(q, [start, stop]))]]
        if twice:
            for query in range(start, stop):
                times = np.zeros(n_rows, dtype=np.int32)
                for (names, code), (q, place) in zip(bands, parts, strict=True):
                    n = np.bincount(place[q == query], minlength=len(names)).astype(np.int32)[code]
                    np.copyto(times, n, where=times == 0)
                yield query, times
            continue
        mask = np.zeros(n_rows, dtype="<u8")
        for (names, code), (q, place) in zip(bands, parts, strict=True):
            held = np.zeros((len(names), MASK_QUERIES), dtype=bool)
            held[place, q - start] = True
            mask |= np.packbits(held, axis=1, bitorder="little").view("<u8").ravel()[code]
        for query in range(start, stop):
            yield query, (mask & np.uint64(1 << (query - start))) != 0


def marked_rows(ids, lists):
    """``(ends, row, n)``: for each list the rows whose id stands in it, and how often."""
    known = pc.unique(ids).drop_null()
    theirs, own = codes(pc.list_flatten(lists), known), codes(ids, known)
    asker = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    entry, held = np.flatnonzero(theirs >= 0), np.flatnonzero(own >= 0)
    entry, row = meetings(entry, theirs[entry], held, own[held])
    cell, n = np.unique(asker[entry].astype(np.int64) * len(ids) + row, return_counts=True)
    return np.searchsorted(cell, np.arange(len(lists) + 1) * len(ids)), cell % max(len(ids), 1), n


def budget_taker(schema, budget, columns):
    """For a cogrouped ``applyInArrow``: all bucket sizes against queries: of the probes of a ``qid`` the first ones within the budget.

    Adds ``kept`` to the queries; those of no id or without a bucket that is not empty have no row.
    """

    def run(sizes, queries):
        if not sizes.num_rows or not queries.num_rows:
            return schema.empty_table()
        sizes = sizes.sort_by([("band", "ascending"), ("band_key", "ascending")])
        band, key, size = (column(sizes, n).to_numpy(zero_copy_only=False) for n in ("band", "band_key", "size"))
        most = size[band == 0].sum() * budget
        probes, qid = column(queries, "probes"), column(queries, "qid")
        code = pc.fill_null(qid.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        asker, flat = pc.list_parent_indices(probes).to_numpy(zero_copy_only=False), pc.list_flatten(probes)
        theirs, wanted = (pc.struct_field(flat, n).to_numpy(zero_copy_only=False) for n in ("band", "key"))
        # place of each probe's bucket among the sizes, -1 for an empty bucket
        bucket = np.full(len(flat), -1)
        for b in np.unique(band):
            mine, own = np.flatnonzero(theirs == b), slice(*np.searchsorted(band, [b, b + 1]))
            at = np.minimum(np.searchsorted(key[own], wanted[mine]), own.stop - own.start - 1)
            bucket[mine] = np.where(key[own][at] == wanted[mine], own.start + at, -1)
        place = np.arange(len(flat)) - np.searchsorted(asker, asker)
        hit = np.flatnonzero((bucket >= 0) & (code[asker] >= 0))
        owner, bucket = code[asker[hit]], bucket[hit]
        if (np.diff(owner) < 0).any() or len(np.unique(code)) < len(code):
            order = np.lexsort((place[hit], owner))
            owner, bucket = owner[order], bucket[order]
        spent = np.cumsum(size[bucket])
        start = np.searchsorted(owner, owner)
        spent = spent - spent[start] + size[bucket[start]] if len(owner) else spent
        taken = (spent <= most) | (np.arange(len(owner)) == start)
        cell = np.sort(owner[taken] * len(size) + bucket[taken])
        owner, bucket = cell // len(size), cell % len(size)
        ends = np.searchsorted(owner, np.arange(code.max() + 2 if len(code) else 1)).astype(np.int32)
        bands = pa.StructArray.from_arrays([pa.array(band[bucket].astype(np.int32)), pa.array(key[bucket]), pa.array(size[bucket])], ["band", "key", "size"])
        answered = np.flatnonzero((code >= 0) & (np.diff(ends)[np.maximum(code, 0)] > 0) if len(ends) > 1 else np.zeros(len(code), bool))
        kept = pa.ListArray.from_arrays(pa.array(ends), bands).take(pa.array(code[answered]))
        out = queries.select(["qid", *columns]).take(pa.array(answered)).append_column("kept", kept)
        return out.cast(schema)

    return run


def bound_finder(schema, slack=None):
    """For a cogrouped ``applyInArrow``: blocks' greatest and least weights against queries.

    Without ``slack`` each query's block of the highest bound (ties: the first), else all
    whose bound reaches the query's ``kth`` less the slack, or all if it has none.
    """

    def run(blocks, queries):
        if not blocks.num_rows or not queries.num_rows:
            return schema.empty_table()
        vectors, cells = column(queries, "vector"), column(blocks, "cells")
        row = pc.list_parent_indices(cells).to_numpy(zero_copy_only=False)
        pos, high, low = (pc.struct_field(pc.list_flatten(cells), n).to_numpy(zero_copy_only=False) for n in ("pos", "high", "low"))
        positions = np.unique(flat_indices(vectors)) if pa.types.is_struct(vectors.type) else None
        unit, _ = unit_matrix(vectors, positions)
        named = np.arange(unit.shape[1]) if positions is None else positions
        place = np.minimum(np.searchsorted(named, pos), max(len(named) - 1, 0))
        used = named[place] == pos if len(named) else np.zeros(len(pos), bool)
        most, least = np.zeros((len(cells), len(named))), np.zeros((len(cells), len(named)))
        most[row[used], place[used]], least[row[used], place[used]] = high[used], low[used]
        bound = np.maximum(unit, 0.0) @ most.T + np.minimum(unit, 0.0) @ least.T
        number, qid = column(blocks, "id").to_numpy(zero_copy_only=False), column(queries, "qid")
        if slack is None:
            order = np.argsort(number, kind="stable")
            at = order[np.argmax(bound[:, order], axis=1)]
            out = {"qid": qid, "block": pa.array(number[at]), "bound": pa.array(bound[np.arange(len(at)), at])}
        else:
            kth = pc.fill_null(column(queries, "kth"), -np.inf).to_numpy(zero_copy_only=False)
            q, at = np.nonzero(bound >= kth[:, None] - slack)
            out = {"qid": qid.take(pa.array(q)), "block": pa.array(number[at])}
        return pa.table(out).cast(schema)

    return run
