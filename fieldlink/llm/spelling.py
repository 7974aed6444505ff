"""Operator 11: spelling variants by K-d trees over letter-count vectors.

1. Tasks count the words of their texts; counts join by word.
2. Words become vectors of letter counts. One edit moves a vector by an L1 distance of at
   most two: a replaced letter by one up and one down at equal lengths, an inserted
   one by one up into the next length. So the words of a length meet those of that
   length and of the next only, and a range search is a walk through a K-d tree that
   carries at most one step up and one step down: a branch whose box those don't
   reach is pruned.
3. The top of each length's tree is built for all words at once: each level is a pass that counts,
   for every cell of more than `cell` words, how many words have how many of
   each letter, and splits it where that halves it best. A word goes to its own cell and to those that its
   searches reach (of equal length only later ones, so that each pair is looked for once).
4. In a cell the tree goes on down to leaves, where vectors are compared; what is at
   the right distance is verified by the order of its letters. A word leaves the cell with
   its number of near words and the best of them, which are joined by word.
5. A word's form is its near word of largest count, if that has at least `ratio` times
   its own; roots follow forms by pointer jumping, whose rounds grow with the logarithm of the longest path.

A null or empty text, or one without letters, has no words; a null id counts as an empty text in
a word's hash; repeated rows and ids count as often as they are there; ties between
near words go to the smallest in code-point order. Very long texts are read whole and
very long runs are words like others. Words of the same letters in another order are
never near; where more than `cell` of them fill a cell they are dealt to several by hash. Columns
besides id and text aren't read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Runs of letters (a fixed pattern, after lower-casing A-Z).
NO_LETTER = "[^a-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO, MODULUS = 5, 3, 2, 97
SLICE = 8 << 20
#: Words and characters of a cell; words of a leaf; queries walked through a cell's tree at once; letters gathered at once.
CELL, CELL_CHARS, LEAF, QUERIES, GATHERED = 32_768, 4 << 20, 128, 16_384, 4 << 20
LETTERS = 90
CODE = np.full(256, -1, np.int16)
CODE[97:123] = np.arange(26)
CODE[0xC0:0x100] = np.arange(26, LETTERS)
#: States of a walk: a step not taken yet, one that isn't allowed; else the letter it was taken on.
FREE, NONE = -1, -9


def crc_tables(most: int = 64) -> np.ndarray:
    """[n, k, byte]: what byte k of a crc32 becomes when n further bytes of 0 follow, without the sum's own start and end."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    out = [now]
    for _ in range(most):
        now = one[now & 0xFF] ^ (now >> np.uint32(8))
        out.append(now)
    return np.stack(out)


CRC = crc_tables()


def joined_crc(before: np.ndarray, after: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of texts a + b from those of a and b, and the bytes of b, at most 64."""
    moved = [CRC[length, k, (before >> np.uint32(8 * k)) & np.uint32(0xFF)] for k in range(4)]
    return moved[0] ^ moved[1] ^ moved[2] ^ moved[3] ^ after


def counted(ids: pa.Array, texts: pa.Array, least: int, modulus: int) -> tuple[pa.Array, np.ndarray]:
    """(words of at least `least` letters, how often each is in the texts), after the deletions that hashes of id and run ask for; a word may come twice."""
    runs = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), NO_LETTER)
    coded = runs.flatten().dictionary_encode()
    code, per = coded.indices.to_numpy(zero_copy_only=False), pc.list_value_length(runs).to_numpy(zero_copy_only=False)
    some = coded.dictionary
    if not len(code):
        return some, np.zeros(0, np.int64)
    size, n_bytes = (pc.cast(f(some), pa.int64()).to_numpy(zero_copy_only=False) for f in (pc.utf8_length, pc.binary_length))
    doc = np.repeat(np.arange(len(per)), per)
    real = size[code] >= least
    code, doc = code[real], doc[real]
    words = some.to_pylist()
    first = np.array([zlib.crc32(f"{i}:".encode()) for i in pc.fill_null(ids, "").to_pylist()], dtype=np.uint32)
    own = np.zeros(len(words), np.uint32)
    used = np.unique(code)
    own[used] = [zlib.crc32(words[i].encode()) for i in used]
    h = joined_crc(first[doc], own[code], np.minimum(n_bytes[code], len(CRC) - 1))
    for i in np.flatnonzero(n_bytes[code] >= len(CRC)):
        h[i] = zlib.crc32(words[code[i]].encode(), int(first[doc[i]]))
    hit = h % np.uint32(modulus) == 0
    whole = np.bincount(code[~hit], minlength=len(words))
    place = h[hit] % size[code[hit]]
    cut, times = np.unique((code[hit].astype(np.int64) << 32) | place, return_counts=True)
    at = np.flatnonzero(whole)
    shorter = [(words[c][:k] + words[c][k + 1 :], n) for c, k, n in zip((cut >> 32).tolist(), (cut & 0xFFFFFFFF).tolist(), times.tolist()) if size[c] > least]
    return pa.concat_arrays([pc.take(some, pa.array(at)), pa.array([w for w, _ in shorter], pa.string())]), np.concatenate([whole[at], np.array([n for _, n in shorter], np.int64)])


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, times: int = LEAST_COUNT, modulus: int = MODULUS) -> DataFrame:
    """(word, n): the words of at least `least` letters that the texts have at least `times` times."""
    chosen = docs.select(F.col(f"`{doc_id}`").cast("string").alias("i"), F.col(f"`{text}`").cast("string").alias("t"))

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "t", most=SLICE):
                word, n = counted(part.column("i"), part.column("t"), least, modulus)
                yield pa.RecordBatch.from_arrays([word, pa.array(n, pa.int64())], names=["word", "n"])

    return chosen.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def letters_of(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all words one after the other, where each begins and the last ends)."""
    return CODE[np.frombuffer("".join(some).encode("latin-1"), np.uint8)], common.starts_of(np.fromiter(map(len, some), np.int64, len(some)))


def vectors(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Letter counts of each word."""
    n = len(starts) - 1
    row = np.repeat(np.arange(n), np.diff(starts))
    return np.bincount(row * LETTERS + flat, minlength=n * LETTERS).reshape(n, LETTERS)


class Tree:
    """A K-d tree: nodes (letter, least count on the right, left child, right child), or leaves (-1, parts, id, id)."""

    def __init__(self):
        self.nodes = [(-1, 1, 0, 0)]

    def walk(self, counts: np.ndarray, up: int, down: int):
        """(leaf, rows) of all leaves that rows of counts reach with the steps allowed; a row comes to a leaf at most once."""
        n = len(counts)
        todo = [(0, np.arange(n), np.full(n, up, np.int16), np.full(n, down, np.int16))]
        while todo:
            node, rows, u, d = todo.pop()
            letter, least, left, right = self.nodes[node]
            if letter < 0:
                yield node, rows
                continue
            c = counts[rows, letter]
            moved = c + (u == letter) - (d == letter)
            fixed = (u == letter) | (d == letter)
            over = moved >= least
            rise, fall = ~fixed & (u == FREE) & (c == least - 1), ~fixed & (d == FREE) & (c == least)
            for child, free, step in ((left, ~over, fall), (right, over, rise)):
                here = free | step
                if here.any():
                    nu, nd = u[here], d[here]
                    (nd if child == left else nu)[step[here]] = letter
                    todo.append((child, rows[here], nu, nd))

    def split(self, leaf: int, letter: int, least: int) -> tuple[int, int]:
        left = len(self.nodes)
        self.nodes += [(-1, 1, 0, 0), (-1, 1, 0, 0)]
        self.nodes[leaf] = (letter, least, left, left + 1)
        return left, left + 1


def grown(counts: np.ndarray, leaf: int) -> tuple[Tree, dict[int, np.ndarray]]:
    """A tree over the rows of counts, and the rows of each leaf: of at most `leaf` rows, or all with the same counts."""
    tree, rows_of, todo = Tree(), {}, [(0, np.arange(len(counts)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) > leaf:
            own = counts[rows]
            best = None
            for least in range(1, int(own.max()) + 1) if own.max() <= 8 else np.unique(own[own > 0]):
                share = (own >= least).sum(0)
                off = np.abs(2 * share - len(rows))
                off[(share == 0) | (share == len(rows))] = 2 * len(rows)
                k = int(off.argmin())
                if off[k] < 2 * len(rows) and (best is None or off[k] < best[0]):
                    best = (int(off[k]), k, int(least))
            if best is not None:
                over = own[:, best[1]] >= best[2]
                left, right = tree.split(node, best[1], best[2])
                todo += [(left, rows[~over]), (right, rows[over])]
                continue
        rows_of[node] = rows
    return tree, rows_of


def one_replaced(flat: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether words of equal length, given by where they begin, differ in one place."""
    at = np.arange(length)
    return (flat[a[:, None] + at] != flat[b[:, None] + at]).sum(1) == 1


def one_inserted(flat: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the word at b is that at a, of `length` letters, with one more letter in it."""
    at = np.arange(length)
    x = flat[a[:, None] + at]
    head, tail = x == flat[b[:, None] + at], x == flat[b[:, None] + at + 1]
    first = np.where(head.all(1), length, head.argmin(1))
    last = np.where(tail.all(1), length, tail[:, ::-1].argmin(1))
    return first + last >= length


def near_pairs(own: list[str], same: list[str], shorter: list[str], leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs (i, j) of places in own + same + shorter: within own (words of one length), of same with own, and of shorter (one letter less) with own. No pair comes twice."""
    length, n = len(own[0]), len(own)
    flat, starts = letters_of([*own, *same, *shorter])
    points = vectors(flat[: starts[n]], starts[: n + 1])
    tree, rows_of = grown(points, leaf)
    used = np.flatnonzero(points.any(0))
    kind = np.float32 if length * length < 1 << 22 else np.float64
    table = {node: (points[rows][:, used].astype(kind), (points[rows] ** 2).sum(1).astype(kind)) for node, rows in rows_of.items()}
    out_i, out_j = [], []
    steps = max(1, min(QUERIES, GATHERED // length))
    for first, last, down, verify, size in ((0, n + len(same), FREE, one_replaced, length), (n + len(same), len(starts) - 1, NONE, one_inserted, length - 1)):
        for at in range(first, last, steps):
            ids = np.arange(at, min(at + steps, last))
            q = vectors(flat[starts[ids[0]] : starts[ids[-1] + 1]], starts[ids[0] : ids[-1] + 2] - starts[ids[0]])
            norm, narrow = (q**2).sum(1).astype(kind), q[:, used].astype(kind)
            for node, rows in tree.walk(q, FREE, down):
                p, p_norm = table[node]
                far = norm[rows][:, None] + p_norm[None] - 2 * (narrow[rows] @ p.T)
                # whole vectors with sums that differ by 0 or 1: a squared distance of 2 is one up and one down, of 1 one up
                x, y = np.nonzero(far == (2 if down == FREE else 1))
                i, j = ids[rows[x]], rows_of[node][y]
                good = (i >= n) | (i < j)
                i, j = i[good], j[good]
                for k in range(0, len(i), max(1, GATHERED // length)):
                    a, b = i[k : k + max(1, GATHERED // length)], j[k : k + max(1, GATHERED // length)]
                    ok = verify(flat, starts[a], starts[b], size)
                    out_i.append(a[ok])
                    out_j.append(b[ok])
    return np.concatenate([*out_i, np.zeros(0, np.int64)]), np.concatenate([*out_j, np.zeros(0, np.int64)])


def by_length(some: list[str]):
    """(length, places of the words that have it)."""
    size = np.fromiter(map(len, some), np.int64, len(some))
    for length in np.unique(size):
        yield int(length), np.flatnonzero(size == length)


def trees_of(table: DataFrame, cell: int, chars: int) -> dict[int, Tree]:
    """The tops of the trees of those lengths that have more words than a cell takes; the driver holds a few numbers a cell."""
    room = lambda length: max(1, min(cell, chars // length))
    size = F.length("word")
    large = table.groupBy(size.alias("length")).count().where(F.col("count") > F.greatest(F.lit(1), F.least(F.lit(cell), F.floor(F.lit(chars) / F.col("length"))))).collect()
    trees, open_ = {r.length: Tree() for r in large}, {(r.length, 0): r["count"] for r in large}
    while open_:
        lengths, known, cells = sorted({length for length, _ in open_}), dict(trees), set(open_)

        def run(batches):
            for batch in batches:
                some, rows = batch.column("word").to_pylist(), []
                for length, places in by_length(some):
                    for at in range(0, len(places), max(1, GATHERED // length)):
                        flat, starts = letters_of([some[i] for i in places[at : at + max(1, GATHERED // length)]])
                        counts = vectors(flat, starts)
                        for node, own in known[length].walk(counts, NONE, NONE):
                            if (length, node) in cells:
                                held = counts[own]
                                for v in np.unique(held[held > 0]):
                                    m = (held == v).sum(0)
                                    rows += [(length, node, int(j), int(v), int(m[j])) for j in np.flatnonzero(m)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], names=["length", "node", "letter", "least", "m"])

        held = table.where(size.isin(lengths)).select("word").mapInArrow(run, "length long, node long, letter long, least long, m long").groupBy("length", "node", "letter", "least").agg(F.sum("m").alias("m"))
        over = F.sum("m").over(Window.partitionBy("length", "node", "letter").orderBy(F.col("least").desc()))
        sizes = table.sparkSession.createDataFrame([(a, b, c) for (a, b), c in open_.items()], "length long, node long, n long")
        halves = held.withColumn("over", over).join(F.broadcast(sizes), ["length", "node"]).where("over < n")
        best = halves.groupBy("length", "node").agg(F.min(F.struct(F.abs(2 * F.col("over") - F.col("n")).alias("off"), "letter", "least", "over")).alias("b")).collect()
        chosen, now = {(r.length, r.node): r.b for r in best}, {}
        for (length, node), n in open_.items():
            if (length, node) not in chosen:  # the same letters in every word
                trees[length].nodes[node] = (-1, -(-n // room(length)), 0, 0)
                continue
            b = chosen[length, node]
            for child, m in zip(trees[length].split(node, b.letter, b.least), (n - b.over, b.over)):
                if m > room(length):
                    now[length, child] = m
        open_ = now
    return trees


def dealt(table: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """(length, node, part, role, word, n): each word in its own cell (role 0) and in those that its searches reach (1: of its length, 2: of the next)."""
    plain = Tree()

    def run(batches):
        for batch in batches:
            some, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy(zero_copy_only=False)
            out: list[tuple[np.ndarray, ...]] = []

            def send(length: int, node: int, part, role: int, rows: np.ndarray) -> None:
                if len(rows):
                    out.append((*(np.broadcast_to(np.asarray(v, np.int32), len(rows)) for v in (length, node, part, role)), rows))

            for length, places in by_length(some):
                own, above = trees.get(length, plain), trees.get(length + 1, plain)
                for at in range(0, len(places), max(1, GATHERED // length)):
                    rows = places[at : at + max(1, GATHERED // length)]
                    vector = vectors(*letters_of([some[i] for i in rows])) if length in trees or length + 1 in trees else np.zeros((len(rows), LETTERS), np.int64)
                    home = np.zeros(len(rows), np.int64)
                    for node, here in own.walk(vector, NONE, NONE):
                        home[here] = node
                        parts = own.nodes[node][1]
                        send(length, node, [zlib.crc32(some[rows[i]].encode()) % parts for i in here] if parts > 1 else 0, 0, rows[here])
                    for tree, grade, role, down in ((own, length, 1, FREE), (above, length + 1, 2, NONE)):
                        for node, here in tree.walk(vector, FREE, down):
                            here = here[home[here] < node] if role == 1 else here
                            for part in range(tree.nodes[node][1]):
                                send(grade, node, part, role, rows[here])
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int32)] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:4]), pc.take(batch.column("word"), pa.array(columns[4])), pa.array(counts[columns[4]])], names=["length", "node", "part", "role", "word", "n"])

    return table.mapInArrow(run, "length int, node int, part int, role int, word string, n long")


def neighbours(table: DataFrame, cell: int = CELL, chars: int = CELL_CHARS, leaf: int = LEAF) -> DataFrame:
    """(word, n_near, form, form_n) of the words of `table` (word, n) that have near words: their number and the one of largest n."""
    trees = trees_of(table, cell, chars)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("role", "ascending"), ("word", "ascending")])
        role, n = group.column("role").to_numpy(), group.column("n").to_numpy()
        word = group.column("word").combine_chunks()
        a, b = np.searchsorted(role, [1, 2])
        some = word.to_pylist()
        i, j = near_pairs(some[:a], some[a:b], some[b:], leaf) if a else (np.zeros(0, np.int64),) * 2
        x, y = np.concatenate([i, j]), np.concatenate([j, i])
        rank = np.empty(len(some), np.int64)
        rank[pc.sort_indices(pa.table({"n": -n, "w": word}), [("n", "ascending"), ("w", "ascending")]).to_numpy()] = np.arange(len(some))
        at = np.argsort(rank)
        times, best = np.bincount(x, minlength=len(some)), np.full(len(some), len(some))
        np.minimum.at(best, x, rank[y])
        hit = np.flatnonzero(times)
        return pa.table({"word": pc.take(word, pa.array(hit)), "n_near": pa.array(times[hit]), "form": pc.take(word, pa.array(at[best[hit]])), "form_n": pa.array(n[at[best[hit]]])})

    found = dealt(table, trees).groupBy("length", "node", "part").applyInArrow(run, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select("word", "n_near", F.col("_b.form").alias("form"), (-F.col("_b.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words of forms (word, form): the last of the forms that follow from a word."""
    with common.scratch(forms.sparkSession) as keep:
        now = common.written(forms.select("word", F.col("form").alias("root")), "roots")
        while True:
            above = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
            now = common.written(now.join(above, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved")), "roots")
            if not now.where("_moved").limit(1).count():
                return keep(now).select("word", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ratio: float = RATIO, cell: int = CELL, **how) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row for each word of docs."""
    table = common.written(words(docs, doc_id, text, **how), "words")
    near = table.join(neighbours(table, cell), "word", "left")
    takes = F.col("form_n") >= ratio * F.col("n")
    formed = common.written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("form")).alias("form"), F.when(takes, F.col("form_n")).alias("form_n")), "forms")
    common.deleted(docs.sparkSession, [table._written_at])
    return formed.join(roots(formed.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
