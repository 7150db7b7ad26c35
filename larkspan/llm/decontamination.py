"""Benchmark decontamination by the q-gram lemma.

A passage of at least WINDOW normalised characters of a benchmark item (the
whole item, if it is shorter) that occurs in a text with at most k edits shares
WINDOW + 1 - q (k + 1) of its q-grams with it, all within k diagonals. One pass
over each text hashes its q-grams, looks them up, deals the shared ones into
overlapping bands of diagonals, and keeps a band's passages that reach the
bound; banded alignment verifies these, and those that touch are one region.

Normalised: letters and digits in lower case, every run of others one space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Gram length, which is the least item searched by grams, passage length, and edits for each 100 characters.
Q, WINDOW, EDITS = 12, 60, 5
#: Characters of benchmark text broadcast at once; more are searched block by block.
BLOCK_CHARS = 8_000_000
#: Characters of text normalised and hashed together.
CHUNK = 1 << 20

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
_lut: list[np.ndarray] = []


def _table() -> np.ndarray:
    """For code points of the basic plane: lower case if a letter or digit, else 0."""
    if not _lut:
        signs = [chr(i) for i in range(1 << 16)]
        _lut.append(np.array([ord(low[0]) if c.isalnum() and len(low := c.lower()) else 0 for c in signs], np.uint32))
    return _lut[0]


def normalize(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, places, offsets): normalised codes of all texts, where each stood in its text, and where texts begin.

    A space at a text's begin or end is dropped only where nothing precedes it.
    """
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.array([len(t) for t in texts], np.int64)
    offs = np.concatenate([[0], np.cumsum(lens)])
    table = _table()
    codes = np.where(raw < 1 << 16, table[np.minimum(raw, 0xFFFF)], raw)
    before = np.concatenate([[0], codes[:-1]]).astype(np.uint32)
    before[offs[:-1][lens > 0]] = 0
    keep = np.flatnonzero((codes != 0) | (before != 0))
    cuts = np.searchsorted(keep, offs)
    return codes[keep], keep - np.repeat(offs[:-1], np.diff(cuts)), cuts


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of each run of q codes, doubling the run's length step by step."""
    base, mod = 0x9E3779B97F4A7C15, 1 << 64
    parts = {1: (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)}
    n = 1
    while 2 * n <= q:
        h = parts[n]
        parts[2 * n] = h[:-n] * np.uint64(pow(base, n, mod)) + h[n:] if len(h) > n else h[:0]
        n *= 2
    out, done = parts[n], n
    while done < q:
        step = 1 << ((q - done).bit_length() - 1)
        m = max(0, len(codes) - done - step + 1)
        out = out[:m] * np.uint64(pow(base, step, mod)) + parts[step][done : done + m]
        done += step
    out = out ^ (out >> np.uint64(29))
    return out * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """The q-grams of benchmark items, with each item's passage length, edit budget and bound."""

    BITS = 22

    def __init__(self, items: list[tuple[int, str]]):
        codes, _, cuts = normalize([t for _, t in items])
        self.items = [codes[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.items = [c[:-1] if len(c) and c[-1] == 0 else c for c in self.items]
        self.short: dict[int, list[tuple[int, int]]] = {}  # (hash, id) of items under Q characters, by length
        for i, c in enumerate(self.items):
            if 0 < len(c) < Q:
                self.short.setdefault(len(c), []).append((int(gram_hashes(c, len(c))[0]), items[i][0]))
        usable = [i for i, c in enumerate(self.items) if len(c) >= Q]
        self.items, self.ids = [self.items[i] for i in usable], np.array([items[i][0] for i in usable], np.int64)
        self.n = np.array([min(WINDOW, len(c)) for c in self.items], np.int64)
        self.k = np.minimum(self.n * EDITS // 100, self.n // Q - 1)
        self.bound = self.n + 1 - Q * (self.k + 1)
        grams = [gram_hashes(c) for c in self.items]
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)]).astype(np.int64)
        flat = np.concatenate([*grams, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.grams, self.item, self.place = flat[order], item[order], place[order]
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[self.grams >> np.uint64(64 - self.BITS)] = True

    def shared(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where, item, place) of every shared q-gram."""
        maybe = np.flatnonzero(self.seen[hashes >> np.uint64(64 - self.BITS)])
        low, high = (np.searchsorted(self.grams, hashes[maybe], side) for side in ("left", "right"))
        many = high - low
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.repeat(maybe, many), self.item[at], self.place[at]


def _edit_rows(passages: np.ndarray, text: np.ndarray, base: np.ndarray, width: int):
    """The rows of edits before the first sign of every passage and after each; column w of row i stands for the text place base + w + i.

    An occurrence may begin anywhere; what the band reaches beyond the text
    equals no sign.
    """
    at = base[:, None] + np.arange(passages.shape[1] + width - 1)
    there = np.where((at >= 0) & (at < len(text)), text[np.clip(at, 0, len(text) - 1)], np.uint32(0xFFFFFFFF))
    steps = np.arange(width, dtype=np.int32)
    down = np.full((len(base), width), 1 << 28, np.int32)
    row = np.zeros((len(base), width), np.int32)
    yield row
    for i in range(passages.shape[1]):
        down[:, :-1] = row[:, 1:] + 1  # the passage's sign is left out
        new = np.minimum(row + (there[:, i : i + width] != passages[:, i, None]), down) - steps
        row = np.minimum.accumulate(new, axis=1) + steps  # a sign of the text is extra
        yield row


def windows(item: np.ndarray, starts: np.ndarray, n: int, text: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end) of the cheapest occurrence in the text of each window of n signs of the item on diagonals low..high.

    A diagonal is text place less item place.
    """
    for row in _edit_rows(item[starts[:, None] + np.arange(n)], text, starts + low, high - low + 1):
        pass
    best = row.argmin(axis=1)
    return row[np.arange(len(starts)), best], np.clip(starts + low + best + n, 0, len(text))


def align(passage: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int, int, int]:
    """(first, last, start, end, edits): the stretch of the passage, and of the text, that agree best on diagonals low..high.

    Of the cheapest alignment of the whole passage, the run with the most
    equal signs less edits; it begins and ends with equal signs.
    """
    rows = [r[0] for r in _edit_rows(passage[None], text, np.array([low]), high - low + 1)]
    i, w, way = len(passage), int(rows[-1].argmin()), []
    while i:
        at = low + w + i - 1  # text place of the diagonal step
        differs = not (0 <= at < len(text) and text[at] == passage[i - 1])
        if rows[i][w] == rows[i - 1][w] + differs:
            i -= 1
            way.append((i, at, not differs))
        elif w + 1 < len(rows[i]) and rows[i][w] == rows[i - 1][w + 1] + 1:
            i, w = i - 1, w + 1
            way.append((i, at + 1, False))
        else:
            w -= 1
            way.append((i, at, False))
    way.reverse()
    score = np.concatenate([[0], np.cumsum([1 if same else -1 for *_, same in way])])
    gain = score - np.minimum.accumulate(score)
    last = int(gain.argmax())
    first = last - int(score[last::-1].argmin())
    run = way[first:last]
    return run[0][0], run[-1][0] + 1, run[0][1], run[-1][1] + 1, sum(not same for *_, same in run)


def _pieces(item: np.ndarray, n: int, k: int, bound: int, where: np.ndarray, place: np.ndarray, low: int, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first, last, start, end) of item and text where the windows that verify in one band from diagonal low touch each other.

    where and place are the band's shared q-grams. A window and its band fix
    the stretch of text, so each window is tried once.
    """
    grams = n - Q + 1
    has = np.zeros(len(item) - Q + 1, np.int64)
    has[place] = 1
    total = np.concatenate([[0], np.cumsum(has)])
    starts = np.flatnonzero(total[grams:] - total[:-grams] >= bound)
    if not len(starts):
        return []
    ends = np.full(len(item) - n + 1, -1, np.int64)
    order = np.lexsort((place, where - place))
    diagonal, along = (where - place)[order], place[order]
    if len(along) >= grams:  # windows that stand in the text as they are
        whole = (along[grams - 1 :] - along[: len(along) - grams + 1] == grams - 1) & (diagonal[grams - 1 :] == diagonal[: len(along) - grams + 1])
        at = np.flatnonzero(whole)
        ends[along[at]] = along[at] + diagonal[at] + n
    rest = starts[ends[starts] < 0]
    if len(rest):
        edits, end = windows(item, rest, n, codes, low - k, low + 2 * k + 1 + k)
        ends[rest[edits <= k]] = end[edits <= k]
    starts = np.flatnonzero(ends >= 0)
    if not len(starts):
        return []
    begins = np.maximum(ends[starts] - n, 0)
    cut = np.flatnonzero((np.diff(starts) > n) | (begins[1:] > np.maximum.accumulate(ends[starts])[:-1]))
    out = []
    for a, b in zip([0, *(cut + 1).tolist()], [*cut.tolist(), len(starts) - 1], strict=True):
        out.append((int(starts[a]), int(starts[b]) + n, int(begins[a : b + 1].min()), int(ends[starts[a : b + 1]].max())))
    return out


def _top(region: dict) -> dict:
    """The region that this one was joined into at last."""
    while "into" in region:
        region = region["into"]
    return region


def _fit(index: Index, codes: np.ndarray, i: int, box: list[int], bands: list[int]) -> tuple[int, int, int, int]:
    """(item number, start, end, edits) of a stretch of the item and the text, aligned and grown as far as both go on alike."""
    (p, r, begin, end), passage, k, edits = box, index.items[i], int(index.k[i]), 0
    if r - p != end - begin or not np.array_equal(passage[p:r], codes[begin:end]):
        low, high = bands[0] * (k + 1) - k, (bands[1] + 2) * (k + 1) - 1 + k
        from_ = max(0, p + low)
        first, last, start, stop, edits = align(passage[p:r], codes[from_ : max(0, r + high)], p + low - from_, p + high - from_)
        p, r, begin, end = p + first, p + last, from_ + start, from_ + stop
    while begin and p and codes[begin - 1] == passage[p - 1]:
        begin, p = begin - 1, p - 1
    while end < len(codes) and r < len(passage) and codes[end] == passage[r]:
        end, r = end + 1, r + 1
    return i, begin, end, edits


def find(index: Index, codes: np.ndarray, where: np.ndarray, item: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(item number, start, end, edits) of all verified regions of one text.

    Every window of an item that reaches the bound in a band is verified;
    windows that touch in item and text, in one band or in bands side by side,
    make one region.
    """
    k = index.k[item]
    step = k + 1
    band = np.floor_divide(where - place, step)
    where, item, place, k = (np.concatenate([x, x]) for x in (where, item, place, k))
    band = np.concatenate([band, band - 1])
    order = np.lexsort((where, band, item))
    where, item, place, band = where[order], item[order], place[order], band[order]
    need = index.bound[item]
    last = np.arange(len(where)) + need - 1
    fits = last < len(where)
    last = np.minimum(last, len(where) - 1)
    fits &= (item[last] == item) & (band[last] == band) & (where[last] - where <= index.n[item] - Q + index.k[item])
    edges = np.flatnonzero(np.concatenate([[True], (np.diff(item) != 0) | (np.diff(band) != 0)]))
    ends = np.append(edges[1:], len(where))
    out, before, joined = [], (-1, 0, []), []
    for g in np.unique(np.searchsorted(edges, np.flatnonzero(fits), "right") - 1).tolist():
        a, e = edges[g], ends[g]
        i, b = int(item[a]), int(band[a])
        n, own = int(index.n[i]), int(index.k[i])
        found = _pieces(index.items[i], n, own, int(index.bound[i]), where[a:e], place[a:e], b * (own + 1), codes)
        beside = before[2] if before[:2] == (i, b - 1) else []
        now = []
        for first, end_, start, end in found:
            region = {"item": i, "band": b, "own": [first, end_, start, end], "box": [first, end_, start, end], "bands": [b, b]}
            for other in [r for r in beside if r[0] < end_ + 1 and first < r[1] + 1 and r[2] <= end and start <= r[3]]:
                top = _top(other[4])
                if top is not region:
                    box, more = region["box"], top["box"]
                    region["box"] = [min(box[0], more[0]), max(box[1], more[1]), min(box[2], more[2]), max(box[3], more[3])]
                    region["bands"][0] = min(region["bands"][0], top["bands"][0])
                    top["into"] = region
            joined.append(region)
            now.append((first, end_, start, end, region))
        before = (i, b, now)
    for region in joined:
        if "into" in region:
            continue
        own = int(index.k[region["item"]])
        whole = _fit(index, codes, region["item"], region["box"], region["bands"])
        if whole[1] > region["box"][2] + 4 * own or whole[2] < region["box"][3] - 4 * own:  # an item or text that repeats itself
            out += [_fit(index, codes, r["item"], r["own"], [r["band"]] * 2) for r in joined if _top(r) is region]
        else:
            out.append(whole)
    return list(dict.fromkeys(out))


def _short(index: Index, codes: np.ndarray, places: np.ndarray, cuts: np.ndarray):
    """The regions of items of fewer than Q characters: whole items, between spaces or the ends of a text."""
    edge = codes == 0
    for n, items in index.short.items():
        if len(codes) < n:
            continue
        hashes, known = gram_hashes(codes, n), {}
        for h, own in items:
            known.setdefault(h, []).append(own)
        for at in np.flatnonzero(np.isin(hashes, np.array(list(known), np.uint64))).tolist():
            t = int(np.searchsorted(cuts, at, "right")) - 1
            if at + n <= cuts[t + 1] and (at == cuts[t] or edge[at - 1]) and (at + n == cuts[t + 1] or edge[at + n]):
                for own in known[int(hashes[at])]:
                    yield t, own, int(places[at]), int(places[at + n - 1]) + 1, 0


def regions(index: Index, texts: list[str]):
    """(text number, item id, start, end, edits) in code points of the texts, for texts taken together."""
    codes, places, cuts = normalize(texts)
    yield from _short(index, codes, places, cuts)
    if len(codes) < Q or not len(index.ids):
        return
    hashes = gram_hashes(codes)
    where, item, place = index.shared(hashes)
    text = np.searchsorted(cuts, where, "right") - 1
    inside = where + Q <= cuts[text + 1]
    where, item, place, text = where[inside], item[inside], place[inside], text[inside]
    if not len(text):
        return
    edges = np.flatnonzero(np.diff(text, prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(text)), strict=True):
        if b - a < index.bound.min():
            continue
        t = int(text[a])
        own = codes[cuts[t] : cuts[t + 1]]
        for i, start, end, edits in find(index, own, where[a:b] - cuts[t], item[a:b], place[a:b]):
            span = places[cuts[t] + start : cuts[t] + end]
            yield t, int(index.ids[i]), int(span[0]), int(span[-1]) + 1, edits


def _chunks(texts: list[str]):
    """(first, texts) of about CHUNK characters each."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if texts:
        yield first, texts[first:]


def _search(shared, text_at: int, id_at: int):
    def run(batches):
        index = Index(shared.value)
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                ids, rows = part.column(id_at).to_pylist(), []
                for first, texts in _chunks([t or "" for t in part.column(text_at).to_pylist()]):
                    rows += [{"doc_id": ids[first + t], "item_id": i, "start": a, "end": b, "edits": e} for t, i, a, b, e in regions(index, texts)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return run


def _keep(shared, text_at: int):
    def run(batches):
        index = Index(shared.value)
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                clean = np.ones(part.num_rows, bool)
                for first, texts in _chunks([t or "" for t in part.column(text_at).to_pylist()]):
                    for t, *_ in regions(index, texts):
                        clean[first + t] = False
                yield part if clean.all() else part.filter(pa.array(clean))

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """The items as broadcast lists, each of about BLOCK_CHARS characters of text at most."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    chars = items.agg(F.sum(F.length("t")).alias("n")).first().n or 0
    n = max(1, -(-2 * chars // BLOCK_CHARS))
    for block in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == block).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(sorted({(-1 if r.i is None else r.i, r.t) for r in rows}))


def contaminated_regions(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, item_id, start, end, edits): where texts hold a benchmark passage; one pass for each block of items.

    start and end bound the region in code points of the text; edits counts
    those of the whole region. A region holds all passages of an item that
    touch each other; one that stands apart, or elsewhere in the text, is
    another. Null and empty
    texts and items without letters or digits match nothing; items of up to 23
    normalised characters match without edits, under Q between spaces only;
    a null item id is -1; repeated rows are searched each; repeated items
    count once. An empty table on either side gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for shared in _blocks(benchmark, item_col, item_text_col):
        one = source.mapInArrow(_search(shared, 1, 0), "doc_id long, item_id long, start long, end long, edits int")
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("doc_id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark passage, in the same pass; columns as given."""
    for shared in _blocks(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(_keep(shared, docs.columns.index(text_col)), docs.schema)
    return docs
