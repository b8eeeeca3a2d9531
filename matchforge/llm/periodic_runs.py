"""Maximal runs of repeated words (stretches with a period) by Lyndon roots.

A text is a sequence of words, named by integers. Phase one of Baier's suffix sorter groups suffixes by their longest
Lyndon prefix: groups are taken from the highest down, every member hands its group's prefix to the nearest earlier
suffix of a lower group, and receivers of the same prefix as often split off from their group. When no group is left, the
length of a suffix's prefix is its entry of the Lyndon array. Done under the order of words and under its reverse, this
gives every Lyndon root; each root is extended to both sides by longest common extensions into a run.

A run of at least `least` words and two periods holds a sequence of least/2 words that occurs twice in the document, and
lies within the stretch that such sequences cover. So only covered stretches are grouped; nothing else of a text can
belong to a run. The work is narrow: documents stay in their tasks, and a task holds about WORDS_AT_ONCE words or one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.llm._common import SPACES, small_batches, tidy

#: Words of documents that are searched together; a longer document is searched alone.
WORDS_AT_ONCE = 1 << 18
LEAST_LENGTH = 12


def lyndon_array(names: list) -> list:
    """Length of the longest Lyndon word that starts at each place, by Baier's grouping; the end is lower than any name."""
    n = len(names)
    members: list = []
    length: list = []
    group = [0] * n
    seat = {c: g for g, c in enumerate(sorted(set(names)))}
    for c in seat:
        members.append([])
        length.append(1)
    for i, c in enumerate(names):
        g = group[i] = seat[c]
        members[g].append(i)
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    before = list(range(-1, n - 1))  # the nearest earlier place that may be in a lower group
    taken = bytearray(n)
    out = [1] * n
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = None
        size = length[g]
        if len(own) == 1:
            i = own[0]
            taken[i] = 1
            out[i] = size
            j = before[i]
            while j >= 0 and taken[j]:
                j = before[j]
            before[i] = j
            handed = ((1, (j,)),) if j >= 0 else ()
        else:
            own.sort()
            times: dict = {}
            for i in own:
                taken[i] = 1
                out[i] = size
                j = before[i]
                while j >= 0 and taken[j]:
                    j = before[j]
                before[i] = j
                times[j] = times.get(j, 0) + 1
            times.pop(-1, None)
            by: dict = {}
            for j, k in times.items():
                by.setdefault(k, []).append(j)
            handed = sorted(by.items(), reverse=True)
        for k, places in handed:
            split: dict = {}
            for j in places:
                h = group[j]
                new = split.get(h)
                if new is None:
                    new = split[h] = len(members)
                    members.append([])
                    length.append(length[h] + k * size)
                    up = above[h]
                    below.append(h)
                    above.append(up)
                    above[h] = new
                    below[up] = new
                group[j] = new
                members[new].append(j)
        g = below[g]
    return out


class Extensions:
    """Longest common extensions in one array of names, exact, by names of all stretches whose length is a power of two."""

    def __init__(self, names):
        import numpy as np

        self.levels = [np.unique(names, return_inverse=True)[1].astype(np.int64)]
        step = 1
        while 2 * step <= len(names):
            last = self.levels[-1]
            pair = last[:-step] * (int(last.max()) + 1) + last[step:]
            self.levels.append(np.unique(pair, return_inverse=True)[1])
            if len(self.levels[-1]) == self.levels[-1].max() + 1:  # all differ, so do all longer ones
                break
            step *= 2

    def right(self, a, b):
        """Common length of what starts at a and at b (a < b)."""
        import numpy as np

        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names = self.levels[k]
            # a level may answer more than once, as levels stop where all names differ
            at = np.flatnonzero(b + out < len(names))
            at = at[names[a[at] + out[at]] == names[b[at] + out[at]]]
            out[at] += 1 << k
        return out

    def left(self, a, b):
        """Common length of what ends before a and before b (a < b)."""
        import numpy as np

        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names, step = self.levels[k], 1 << k
            at = np.flatnonzero(a - out >= step)
            at = at[names[a[at] - out[at] - step] == names[b[at] - out[at] - step]]
            out[at] += step
        return out


def covered(names, document, gram: int):
    """(start, end) of the maximal stretches covered by sequences of `gram` names that occur again in the same document."""
    import numpy as np

    n = len(names) - gram + 1
    if n < 2:
        return np.zeros((0, 2), np.int64)
    with np.errstate(over="ignore"):
        key = np.zeros(n, np.uint64)
        for k in range(gram):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + names[k : k + n].astype(np.uint64)
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + document[:n].astype(np.uint64)
        key ^= key >> np.uint64(30)
    inside = np.flatnonzero(document[:n] == document[gram - 1 :])
    order = inside[np.argsort(key[inside], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]  # equal sequences have equal keys; chance equals only cost time
    again = np.zeros(len(names) + 1, np.int64)
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(again, at, 1)
    np.add.at(again, at + gram, -1)
    held = np.cumsum(again)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]]).astype(np.int8)))
    # sequences of neighbouring documents may touch: cut where the document changes
    starts, ends = edge[::2], edge[1::2]
    cuts = np.flatnonzero(np.diff(document)) + 1
    cuts = cuts[held[cuts] & held[cuts - 1]] if len(cuts) else cuts
    return np.stack([np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))], axis=1)


def find_runs(names, document, least: int = LEAST_LENGTH):
    """(start, length, period) of all runs of at least max(least, 2 * period) names, sorted; no run crosses documents."""
    import numpy as np

    none = np.zeros((0, 3), np.int64)
    spans = covered(names, document, max(1, least // 2))
    spans = spans[spans[:, 1] - spans[:, 0] >= max(2, least)]
    if not len(spans):
        return none
    size = spans[:, 1] - spans[:, 0] + 1
    base = np.cumsum(size) - size
    text = np.full(int(size.sum()), -1, np.int64)
    shift = np.zeros(len(text), np.int64)
    where, period = [], []
    for k, (a, b) in enumerate(spans.tolist()):
        at, n = int(base[k]), b - a
        text[at : at + n] = names[a:b]
        text[at + n] = -1 - k  # ends differ from all names and from each other
        shift[at : at + n + 1] = a - at
        part = names[a:b].tolist()
        for roots in (lyndon_array(part), lyndon_array([-c for c in part])):
            where.append(np.arange(at, at + n))
            period.append(np.array(roots, np.int64))
    where, period = np.concatenate(where), np.concatenate(period)
    ext = Extensions(text)
    right = ext.right(where, where + period)
    left = ext.left(where, where + period)
    length = left + period + right
    good = length >= np.maximum(least, 2 * period)
    if not good.any():
        return none
    start = (where - left)[good]
    return np.unique(np.stack([start + shift[where[good]], length[good], period[good]], axis=1), axis=0)[:, [0, 1, 2]]


def repeated_words(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: int = LEAST_LENGTH, rewrite=None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period), collapsed; one row per input row.

    Words are the maximal sequences of characters other than ASCII white space, numbered from 0. A run is a stretch of at
    least max(least, 2 * period) words with that smallest period which no neighbouring word extends. `collapsed` holds, joined by
    one space, the words that no run has after its first period. `rewrite(doc_id, words)`, if given, returns the words to
    search. Null and empty texts have no words, no runs and the empty text; repeated rows are documents of their own;
    other columns do not matter; an empty table gives an empty result. Memory follows the longest document.
    """
    small_batches(docs.sparkSession)

    def search(ids, texts):
        import numpy as np

        table = str.maketrans(SPACES, " " * len(SPACES))
        words = [[w for w in t.translate(table).split(" ") if w] if t else [] for t in texts]
        if rewrite is not None:
            words = [rewrite(i, w) for i, w in zip(ids, words)]
        seat: dict = {}
        names = np.array([seat.setdefault(w, len(seat)) for ws in words for w in ws], np.int64)
        ends = np.cumsum([len(w) for w in words])
        found = find_runs(names, np.repeat(np.arange(len(words)), [len(w) for w in words]), least)
        owner = np.searchsorted(ends, found[:, 0], side="right")
        cut = np.searchsorted(owner, np.arange(len(words) + 1))
        for d, ws in enumerate(words):
            runs = found[cut[d] : cut[d + 1]] - [int(ends[d]) - len(ws), 0, 0]
            runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))].tolist()
            if runs:
                stays = bytearray(b"\1") * len(ws)
                for start, length, period in runs:
                    stays[start + period : start + length] = bytes(length - period)
                kept = " ".join([w for w, s in zip(ws, stays) if s])
            else:
                kept = " ".join(ws)
            yield ids[d], len(ws), [{"start": a, "length": b, "period": c} for a, b, c in runs], kept

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def done(ids, texts):
            cols = list(zip(*search(ids, texts)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), kind, pa.string()))], ["doc_id", "n_words", "runs", "collapsed"])

        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                if held and held + len(t or "") // 5 > WORDS_AT_ONCE:
                    yield done(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(t)
                held += 1 + len(t or "") // 5
        if ids:
            yield done(ids, texts)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
