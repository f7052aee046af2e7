"""Benchmark questions in documents, also where their numbers, names and units were changed.

Texts become templates: numbers, units behind numbers and names inside sentences are replaced by
typed placeholders, all other words are lower-cased. Windows of a document's template are looked up
in the hash table of the benchmark's windows, which is broadcast in blocks of bounded size. Where
windows meet, the values behind the placeholders must correspond one to one: each value of the
question always stands for the same value of the document.

Capitals tell what a name is, so a copy in other case has another template. Beside the templates there
are therefore case-free windows, in which names are words like any other and only numbers and units
are placeholders. An item is found by either.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hamsieve.llm.kernels import CHUNK, mix, span_hashes, text_bytes, word_spans

#: Template words in a window; items with fewer are one window of their own length.
WINDOW = 5
#: Share of an item's windows that a document must hold.
COVERAGE = 0.5
#: Bytes of benchmark text that are looked up in one pass; a larger benchmark takes more passes. A byte costs some 50
#: in the table that is broadcast (a window has 32 hashes, one for each set of words that may be slots).
BLOCK_BYTES = 2 << 20
#: Bytes of text that are glanced at at once, at most; a longer text is read as a whole.
GLANCE_BYTES = 4 << 20
#: Distinct words that a task remembers before it forgets them all.
MEMORY = 1_000_000

#: Units of measure and currency.
UNITS = frozenset(
    """% percent km m cm mm mi mile miles ft foot feet in inch inches yd yard yards kg g mg lb lbs pound pounds oz
    ounce ounces t ton tons tonne tonnes l ml cl liter liters litre litres gallon gallons s sec second seconds min
    minute minutes h hr hrs hour hours day days week weeks month months year years km/h mph kmh °c °f c f k w kw mw
    kwh v a hz khz mhz ghz b kb mb gb tb $ € £ usd eur gbp dollar dollars euro euros cent cents""".split()
)

_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
_EDGE = "\"'“”‘’«»()[]{}<>,;:.!?…*_`~#&|"
_GLUED = re.compile(r"(\d)([A-Za-zµ°][A-Za-z/°]*)(?![\w])")
_NUM, _UNIT, _NAME, _FIRST_WORD = 1, 2, 3, 4
_CAP, _END, _IS_NUM, _IS_UNIT, _IS_GLUED = 1, 2, 4, 8, 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    """Raw word to number: word id (0 unless the vocabulary has it) and flags."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, raw: str) -> int:
        core = raw.strip(_EDGE)
        flags = _END if raw.rstrip("\"'”’»)]}")[-1:] in (".", "!", "?", "…") else 0
        if core[:1].isupper():
            flags |= _CAP
        if _NUMBER.fullmatch(core):
            flags |= _IS_NUM
        elif _GLUED.search(core):
            flags |= _IS_GLUED
        low = core.lower()
        if low in UNITS:
            flags |= _IS_UNIT
        if len(self) > MEMORY:
            self.clear()
        code = self[raw] = self.vocabulary.get(low, 0) << 5 | flags
        return code


@dataclass
class _Template:
    """Template word ids, and the raw words that each stands for (first, last + 1)."""

    ids: np.ndarray
    first: np.ndarray
    last: np.ndarray
    raw: list[str]
    #: Are values compared in any case?
    folded: bool = False

    def value(self, i: int) -> str:
        value = " ".join(w.strip(_EDGE) for w in self.raw[self.first[i] : self.last[i]])
        return value.lower() if self.folded else value


def _templates(text: str, codes: _Codes) -> tuple[_Template, _Template]:
    """The template of ``text``, and the one without names."""
    raw = text.split()
    n = len(raw)
    code = np.fromiter(map(codes.__getitem__, raw), np.int64, n)
    if (code & _IS_GLUED).any():
        raw = _GLUED.sub(r"\1 \2", text).split()
        n = len(raw)
        code = np.fromiter(map(codes.__getitem__, raw), np.int64, n)
    ids = code >> 5
    begins = np.ones(n, bool)
    begins[1:] = (code[:-1] & _END) > 0
    number = (code & _IS_NUM) > 0
    unit = (code & _IS_UNIT) > 0
    unit[1:] &= number[:-1]
    unit[:1] = False
    name = ((code & _CAP) > 0) & ~begins & ~number & ~unit
    plain = np.where(number, _NUM, np.where(unit, _UNIT, ids))
    ids = np.where(name, _NAME, plain)
    # Names in a row are one.
    kept = np.ones(n, bool)
    kept[1:] = ~(name[1:] & name[:-1])
    first = np.flatnonzero(kept)
    named = _Template(ids[kept], first, np.append(first[1:], n)[: len(first)], raw)
    return named, _Template(plain, np.arange(n), np.arange(1, n + 1), raw, True)


def _windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` ids."""
    if len(ids) < size or not size:
        return np.zeros(0, np.uint64)
    m = mix(ids.astype(np.uint64))
    n = len(ids) - size + 1
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h = h * _BASE + m[j : j + n]
    return mix(h)


#: Stands for a word that may be a slot.
_HIDDEN = np.uint64(0xA0761D6478BD642F)
_BYTES = np.arange(256)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_CORE = _DIGIT | _LETTER
#: Lead bytes of signs and quotes beyond ASCII, and of letters whose case is not that of Latin-1.
_ODD = (_BYTES == 0xC2) | (_BYTES >= 0xC4)
_HIDES = _DIGIT | _ODD
#: Size of the table of literal words' hashes; two words in one place only make a glance less sharp.
_LITERAL_BITS = 1 << 18


#: What str.split() splits at beyond the glance's own white space: first bytes, and whole characters by length.
_WIDE = [c.encode() for c in map(chr, range(0x80, 0x3001)) if c.isspace()]
_WIDE_FIRST = np.isin(_BYTES, [c[0] for c in _WIDE])
_CONTROL = (_BYTES >= 0x1C) & (_BYTES <= 0x1F)


def _plain_spaces(data: np.ndarray) -> np.ndarray:
    """``data`` (UTF-8) with every character that str.split() splits at as blanks, as many as it has bytes."""
    seen = np.flatnonzero((_WIDE_FIRST | _CONTROL)[data])
    if not len(seen):
        return data
    data = data.copy()
    control = seen[_CONTROL[data[seen]]]
    padded = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int64)
    codes = {n: (padded[seen] << 16 | padded[seen + 1] << 8) | (padded[seen + 2] if n == 3 else 0) for n in (2, 3)}
    for n, code in codes.items():
        wide = [int.from_bytes(c.ljust(3, b"\0"), "big") for c in _WIDE if len(c) == n]
        at = seen[np.isin(code, wide)]
        for j in range(n):
            data[at + j] = 0x20
    data[control] = 0x20
    return data


def _span(word: bytes) -> int:
    """Hash of a literal word as the glance sees it: its letters and figures from first to last."""
    data = np.frombuffer(word, np.uint8)
    core = np.flatnonzero(_CORE[data])
    if not len(core):
        return 0
    return int(span_hashes(data, core[:1], core[-1:] + 1)[0])


_UNIT_HASHES = np.array(sorted({_span(u.encode()) for u in UNITS} - {0}), np.uint64)


def _glance(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        h = h * _BASE + mix(rows[:, j])
    return h


class _View:
    """The windows of templates: sorted hashes, with item and place of each."""

    def __init__(self, templates: list[_Template]):
        self.templates = templates
        self.sizes = [min(WINDOW, len(t.ids)) for t in self.templates]
        self.totals = [len(t.ids) - s + 1 if s else 0 for t, s in zip(self.templates, self.sizes, strict=True)]
        hashes = [_windows(t.ids, s) for t, s in zip(self.templates, self.sizes, strict=True)]
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.hashes = every[order]
        self.item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])[order]
        self.place = (np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64))[order]
        self.lengths = sorted({s for s in self.sizes if s})

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Item, its place and the document's place of each pair of equal windows."""
        for size in self.lengths:
            if len(ids) < size:
                continue
            # Only windows of known words can be in the table.
            gaps = np.concatenate([[0], np.cumsum(ids == 0)])
            full = np.flatnonzero(gaps[size:] == gaps[:-size])
            if not len(full):
                continue
            h = _windows(ids, size)[full] if len(full) * 4 > len(ids) else np.concatenate([_windows(ids[p : p + size], size) for p in full])
            lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
            for k in np.flatnonzero(hi > lo):
                for at in range(lo[k], hi[k]):
                    item, place = int(self.item[at]), int(self.place[at])
                    if self.sizes[item] == size and (self.templates[item].ids[place : place + size] == ids[full[k] : full[k] + size]).all():
                        yield item, place, int(full[k])


class WindowTable(_View):
    """The windows of a block of items by templates, and (``plain``) by words in any case."""

    def __init__(self, items: list[tuple[int, str]], coverage: float = COVERAGE):
        self.coverage = coverage
        words = sorted({w.strip(_EDGE).lower() for _, text in items for w in _GLUED.sub(r"\1 \2", text).split()})
        self.vocabulary = {w: i for i, w in enumerate(words, _FIRST_WORD)}
        codes = _Codes(self.vocabulary)
        self.ids = [i for i, _ in items]
        both = [_templates(text, codes) for _, text in items]
        super().__init__([t for t, _ in both])
        self.plain = _View([t for _, t in both])
        views = (self, self.plain)

        # What a glance at raw words needs: the windows with any of their words hidden, by their hashes.
        self.glances: dict[int, np.ndarray] = {}
        lengths = sorted({n for v in views for n in v.lengths})
        every = [(t, own, total) for v in views for t, own, total in zip(v.templates, v.sizes, v.totals, strict=True)]
        spans: dict[str, int] = {}
        seen = [np.array([_HIDDEN], np.uint64)]
        for size in lengths:
            windows = []
            for t, own, _ in every:
                if own == size:
                    h = np.full(len(t.ids), _HIDDEN)
                    for i in np.flatnonzero(t.ids >= _FIRST_WORD).tolist():
                        word = t.value(i)
                        h[i] = spans[word] if word in spans else spans.setdefault(word, _span(word.encode()))
                    windows.append(np.lib.stride_tricks.sliding_window_view(h, size))
                    seen.append(h)
            rows = np.concatenate(windows)
            hashes = np.zeros(0, np.uint64)
            for hide in range(1 << size):
                hidden = np.array([bool(hide >> j & 1) for j in range(size)])
                hashes = np.union1d(hashes, _glance(np.where(hidden, _HIDDEN, rows)))
            self.glances[size] = hashes
        literals = np.unique(np.concatenate(seen))
        self.literals = np.zeros(_LITERAL_BITS, bool)
        self.literals[(literals & np.uint64(_LITERAL_BITS - 1)).astype(np.int64)] = True
        self.needs = {n: min(self.least(total) for _, own, total in every if own == n) for n in lengths}
        self.reach = max((_reach(t) for t in self.templates), default=0)

    def least(self, total: int) -> int:
        """Windows of an item with ``total`` that a document must hold."""
        return max(1, math.ceil(self.coverage * total))

    def stretches(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[str, int]]]]:
        """Texts that may hold an item, and where: each stretch of text, and how many of its first words only lead up to it.

        Told by words in a row that are a window's but for what may be a slot, worked out on bytes for many texts
        at once; it only ever errs on the side of looking closer. A stretch reaches as far as a copy around
        those words can; the two words before it tell what its own first words are.
        """
        data, offsets = text_bytes(column)
        i, n = 0, len(column)
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
            part = data[offsets[i] : offsets[j]]
            if len(part) > GLANCE_BYTES:
                yield i, [(part.tobytes().decode(), 0)]
            else:
                yield from ((i + row, found) for row, found in self._stretches(part, offsets[i : j + 1] - offsets[i]))
            i = j

    def _stretches(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, list[tuple[str, int]]]]:
        at, starts, ends = self._promising(data, bounds)
        if not len(at):
            return
        at = np.unique(at)
        text = np.searchsorted(bounds, starts[at], "right") - 1
        word = np.searchsorted(starts, bounds)
        low = np.maximum(at - self.reach, word[text])
        high = np.minimum(at + self.reach + WINDOW, word[text + 1] - 1)
        # Stretches that meet are one.
        fresh = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (low[1:] > high[:-1] + 1)]))
        low, high, text = low[fresh], np.append(high[fresh[1:] - 1], high[-1]), text[fresh]
        lead = np.maximum(low - 2, word[text])
        found: dict[int, list[tuple[str, int]]] = {}
        for row, first, own, last in zip(text.tolist(), lead.tolist(), low.tolist(), high.tolist(), strict=True):
            before = data[starts[first] : starts[own]].tobytes().decode()
            whole = before + data[starts[own] : ends[last]].tobytes().decode()
            found.setdefault(row, []).append((whole, len(_GLUED.sub(r"\1 \2", before).split())))
        yield from found.items()

    def _promising(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words at which a window may begin; starts and ends of all words."""
        data = _plain_spaces(data)
        starts, ends = word_spans(data, bounds)
        none = np.zeros(0, np.int64)
        if not len(starts):
            return none, starts, ends
        # From the first to the last letter or figure of each word.
        inside = _CORE[data]
        core = np.flatnonzero(inside)
        if not len(core):
            return none, starts, ends
        count = np.zeros(len(data) + 1, np.int32)
        np.cumsum(inside, out=count[1:])
        lo, hi = count[starts], count[ends]
        some = hi > lo
        s = np.where(some, core[np.minimum(lo, len(core) - 1)], starts)
        e = np.where(some, core[np.maximum(hi - 1, 0)] + 1, starts)
        # Latin-1 capitals are lower-cased as A-Z are.
        capital = np.zeros(len(data), bool)
        accents = np.flatnonzero(data[:-1] == 0xC3) + 1
        capital[accents] = (data[accents] <= 0x9E) & (data[accents] != 0x97)
        lowered = data.copy()
        lowered[capital] += 32
        h = span_hashes(lowered, s, e)
        # Figures, capitals, and what case or quotes beyond ASCII could hide.
        hides = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_HIDES[data] | capital, out=hides[1:])
        slot = ~some | (hides[e] > hides[s]) | _UPPER[data[s]]
        # A unit behind a figure is a slot, too.
        behind = np.flatnonzero(slot[:-1]) + 1
        slot[behind[np.isin(h[behind], _UNIT_HASHES)]] = True
        # A figure glued to letters is two words of the template; slots in a row may be one.
        glue = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_DIGIT[data[:-1]] & _LETTER[data[1:]], out=glue[1:-1])
        glued = slot & (glue[np.maximum(e - 1, s)] > glue[s])
        loose = np.concatenate([[False], slot[1:] & slot[:-1]])
        fine = slot | self.literals[(h & np.uint64(_LITERAL_BITS - 1)).astype(np.int64)]
        h = np.where(slot, _HIDDEN, h)
        text = np.searchsorted(bounds, starts, "right")
        found = [none]
        for size, glances in self.glances.items():
            if len(h) < size:
                # Merged or glued slots can make fewer raw words than the window has.
                found.append(np.flatnonzero(loose | glued))
                continue
            n = len(h) - size + 1
            sums = np.zeros(len(h) + 1, np.int32)
            np.cumsum(~fine, out=sums[1:])
            at = np.flatnonzero((sums[size:] == sums[:-size]) & (text[size - 1 :] == text[:n]))
            rows = np.lib.stride_tricks.sliding_window_view(h, size)[at]
            g = _glance(rows)
            exact = glances[np.minimum(np.searchsorted(glances, g), len(glances) - 1)] == g
            free = np.lib.stride_tricks.sliding_window_view(loose, size)[at].any(1)
            # Around a glued figure the words of a window are not counted.
            near = np.flatnonzero(np.convolve(glued, np.ones(size, bool))[size - 1 :][:n])
            begins = np.union1d(at[exact | free], near)
            # So many windows of the item with the fewest must stand within the reach of the longest.
            need = self.needs[size] - 1
            if len(begins) <= need:
                continue
            if need:
                close = np.flatnonzero(begins[need:] - begins[: len(begins) - need] <= self.reach)
                close = close[text[begins[close]] == text[begins[close + need]]]
                begins = begins[close]
            found.append(begins)
        return np.concatenate(found), starts, ends


@dataclass
class _Match:
    windows: int
    slots: int
    changed: int


def _consistent(item: _Template, doc: _Template, size: int, pairs: list[tuple[int, int]]) -> _Match:
    """Windows whose slots agree with those before them; ``pairs``: places in item and document."""
    there: dict[tuple[int, str], str] = {}
    back: dict[tuple[int, str], str] = {}
    good: set[int] = set()
    slots: dict[int, bool] = {}
    for place, at in pairs:
        new: list[tuple[int, str, str]] = []
        fits = True
        for j in range(size):
            kind = int(item.ids[place + j])
            if kind >= _FIRST_WORD or kind == 0:
                continue
            ours, theirs = item.value(place + j), doc.value(at + j)
            if there.get((kind, ours), theirs) != theirs or back.get((kind, theirs), ours) != ours:
                fits = False
                break
            new.append((kind, ours, theirs))
            slots[place + j] = ours != theirs
        if fits:
            good.add(place)
            for kind, ours, theirs in new:
                there[kind, ours] = theirs
                back[kind, theirs] = ours
    return _Match(len(good), len(slots), sum(slots.values()))


def _reach(item: _Template) -> int:
    """Raw words within which the windows of a copy of ``item`` must begin."""
    return 2 * len(item.raw) + 2 * WINDOW


def find_leaks(text: str, table: WindowTable, codes: _Codes) -> list[tuple[int, int, _Match]]:
    """Index, number of windows and match of every item of ``table`` that ``text`` holds; by its template, if both find it."""
    return leaks_of([(text, 0)], table, codes)


def leaks_of(stretches: list[tuple[str, int]], table: WindowTable, codes: _Codes) -> list[tuple[int, int, _Match]]:
    """As ``find_leaks``, of a text of which only ``stretches`` can hold an item; no window begins in a stretch's first words."""
    by_template: dict[int, tuple[int, int, _Match]] = {}
    by_words: dict[int, tuple[int, int, _Match]] = {}
    for text, lead in stretches:
        named, plain = _templates(text, codes)
        for view, doc, best in ((table.plain, plain, by_words), (table, named, by_template)):
            for item, total, match in _leaks(doc, view, table, lead):
                if item not in best or match.windows > best[item][2].windows:
                    best[item] = (item, total, match)
    out = by_words | by_template
    return [out[item] for item in sorted(out)]


def _leaks(doc: _Template, view: _View, table: WindowTable, lead: int) -> list[tuple[int, int, _Match]]:
    found: dict[int, list[tuple[int, int]]] = {}
    for item, place, at in view.hits(doc.ids):
        if doc.first[at] >= lead:
            found.setdefault(item, []).append((place, at))
    out = []
    for item, pairs in sorted(found.items()):
        total, size = view.totals[item], view.sizes[item]
        if len({p for p, _ in pairs}) < table.least(total):
            continue
        # One copy of the item is a run of like distances between the two places, within its reach.
        pairs.sort(key=lambda p: (p[1] - p[0], p[1]))
        reach = _reach(view.templates[item])
        runs: list[list[tuple[int, int]]] = []
        for p in pairs:
            last = runs[-1][-1] if runs else None
            if last and (p[1] - p[0]) - (last[1] - last[0]) <= WINDOW and abs(int(doc.first[p[1]] - doc.first[runs[-1][0][1]])) <= reach // 2:
                runs[-1].append(p)
            else:
                runs.append([p])
        best = max((_consistent(view.templates[item], doc, size, sorted(r, key=lambda p: p[1])) for r in runs), key=lambda m: m.windows)
        if best.windows >= table.least(total):
            out.append((item, total, best))
    return out


def window_tables(benchmark: DataFrame, item_col: str, item_text: str, coverage: float) -> Iterator[Broadcast]:
    """The benchmark's windows in blocks of at most about BLOCK_BYTES of text, a broadcast table each."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("trim(text) <> ''")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0]["n"] or 0
    passes = max(1, math.ceil(size / BLOCK_BYTES))
    for k in range(passes):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == k).orderBy("item", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(WindowTable([(r["item"], r["text"]) for r in block], coverage))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark``, with all their columns; see ``contaminated``."""
    at = docs.columns.index(text_col)
    for table in window_tables(benchmark, item_col, item_text, coverage):

        def keep(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            held = table.value
            codes = _Codes(held.vocabulary)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                texts = batch.column(at).fill_null("")
                for row, found in held.stretches(texts):
                    clean[row] = not leaks_of(found, held, codes)
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """One row per document and item that it holds: id, item, ``n_windows``, ``n_matched``, ``coverage``,
    ``n_slots``, ``n_changed`` (slots whose values differ) and ``reparameterised``.

    Documents without a row are clean. Null and empty texts and items hold nothing and are in nothing;
    an item of fewer words than a window is one window; a copy in other case is found by its words
    (``n_windows`` and the rest are then of the case-free windows); a null id is kept; repeated rows and repeated
    items have a row each; an empty table on either side gives no rows; further columns are ignored.
    Texts are read whole and no row is shuffled. Items are taken in blocks by id, a pass over the
    documents each: what is collected and broadcast is bounded by BLOCK_BYTES.
    """
    texts = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = f"`{id_col}` long, `{item_col}` long, n_windows int, n_matched int, coverage double, n_slots int, n_changed int, reparameterised boolean"
    columns = [id_col, item_col, "n_windows", "n_matched", "coverage", "n_slots", "n_changed", "reparameterised"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]
    out = None
    for table in window_tables(benchmark, item_col, item_text, coverage):

        def scan(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            held = table.value
            codes = _Codes(held.vocabulary)
            for batch in batches:
                rows = []
                for at, found in held.stretches(batch.column(1)):
                    doc = batch.column(0)[at].as_py()
                    for item, total, m in leaks_of(found, held, codes):
                        rows.append((doc, held.ids[item], total, m.windows, m.windows / total, m.slots, m.changed, m.changed > 0))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=columns)

        found = texts.mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out
