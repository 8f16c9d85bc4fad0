"""Text of scanned pages to readable paragraphs: page furniture, words broken across lines, misrecognised characters.

Lines of a scanned text are hard-wrapped; its furniture is found by form and by the report's title. Words are corrected from the
corpus itself: all words are counted, a rare word is linked to much more frequent ones that a plausible glyph edit makes of it, and
skip-gram vectors are learned for every word in a link: over all texts the signed hashes of its neighbours, two to either side, a
neighbour's weight falling with its frequency as subsampling has it. Where the vectors do not agree, which for a word seen once may
be mere noise of the hashes, the skip-gram pairs themselves are counted and decide. In each place the link that agrees best with
the place's own neighbours is taken. Then furniture goes and the text is reflowed.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.llm.name_forms import distance, segments
from veinstone.session import stored

#: Shown glyphs and what they may stand for.
GLYPHS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("!", "l"), ("!", "i"), ("@", "a"), ("5", "s"), ("$", "s"), ("8", "b"), ("6", "b"), ("6", "g"), ("9", "g"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"),
    ("c", "e"), ("e", "c"), ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("vv", "w"), ("w", "vv"), ("ii", "u"), ("u", "ii"), ("li", "h"), ("h", "li"), ("in", "m"), ("m", "in"), ("nn", "m"), ("m", "nn"),
    ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("l", "i"), ("i", "l"), ("l", "t"), ("t", "l"), ("i", "j"), ("j", "i"), ("q", "g"), ("g", "q"), ("u", "n"), ("n", "u"), ("v", "y"), ("y", "v"), 
    ("lc", "k"), ("k", "lc"), ("ol", "d"), ("d", "ol"), ("lo", "b"), ("b", "lo"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("fi", "h"), ("tl", "d"), ("lt", "k"), ("ct", "d"), ("€", "e"), ("£", "e"), ("¢", "c"), ("ß", "b"), ("é", "e"), ("è", "e"), ("à", "a"), ("ö", "o"), ("ü", "u"),
]
#: Numbers of a skip-gram vector, and neighbours to either side.
SIZE, WINDOW = 64, 2
#: Share of all words above which a neighbour counts less: by the root of this over its share (subsampling of frequent words).
SAMPLE = 1e-3
#: A word is linked to one RATIO times as frequent (a word seen once or twice: FEW times), with at least FREQUENT occurrences.
#: Words with digits or symbols among their letters, which no language has, need one occurrence of what they stand for.
RATIO, FEW, FREQUENT, FREQUENT_IMPOSSIBLE = 20, 4, 3, 1
#: Cosine from which a link's vectors agree. Noise of the hashes is about 1 / sqrt(SIZE), so below it neighbours are counted.
AGREEMENT = 0.2
#: A neighbour speaks for a link if it stands beside the frequent word so many times as often as chance has it.
LIFT = 8
#: Values of the hash that marks the words in links (a constant, whatever the corpus).
MARKS = 1 << 20
#: Pairs of words worked on at a time, and words whose sums a task holds before it gives them on.
AT_ONCE, HELD = 500_000, 50_000
#: Cells of a matrix of counts of neighbours.
DENSE = 20_000_000
#: Lines shorter than this are no hard-wrapped prose.
NARROWEST = 16

_EDGE = ".,;:?!()[]{}\"“”„«»'’‘…—–*<>"
_INDICATOR = re.compile(r"[/\\_]|\w\.\w|^(?=.*\d)[0-9a-fA-F]{6,}$|^cve-|^ta\d{4}$|^[\d.,:%+-]+$|@.*\.|^h[tx]{2}p|#", re.I)
_HYPHENS, _BROKEN, _STARTS = frozenset("-‐\u00ad¬"), re.compile("\\w[-‐\u00ad¬]\\s*$"), re.compile(r"\s*\w")
_HAN = re.compile("[㐀-鿿]")
_SCHEME = re.compile("h[tx]{2}p", re.I)
_OPEN = frozenset("and or und oder et ou y o e u sowie bis to as nor".split())
_DIGITS = r"[0-9IlOoSZB|]{1,5}"
_NUMBER = re.compile(rf"(?i:^\W*(?:(?:page|pag|pg|p|seite|s|página|pág|第)\.?\s*)?)(?-i:{_DIGITS})(?i:\s*(?:of|/|von|de|sur|out of)\s*(?-i:{_DIGITS}))?\s*页?\W*$")
_WITH_NUMBER = [re.compile(rf"^\W*{_DIGITS}\s*(?:[|·•/–—-]|\s{{2,}})\s*(?=\S*[A-Za-z])"), re.compile(rf"\s*(?:[|·•/–—-]|\s{{2,}})\s*(?i:(?:page|seite|p\.|pág\.|página)\s*)?{_DIGITS}(?:\s*(?:of|/|von|de)\s*{_DIGITS})?\W*$")]
_MARKING = re.compile(r"\s*[–—|-]\s*TLP\s*:?\s*\w+\W*$", re.I)


def is_scanned(lines: list[str]) -> bool:
    """Whether lines break where the next word would not have fitted, as hard-wrapped text does."""
    spaced = sorted((len(x.rstrip()) for x in lines if " " in x.strip()), reverse=True)
    if not spaced:
        return False
    width = spaced[len(spaced) // 8]  # a few running heads may be longer than the text is wide
    if width < NARROWEST:
        return False
    full = fits = 0
    least = min(25, width // 2)
    for a, b in zip(lines, lines[1:]):
        a, b = a.rstrip(), b.strip()
        if len(a) >= least and " " in a and b and a[-1] not in ".!?:":
            word = b.split(" ", 1)[0]
            if len(a) + 1 + len(word) > width - 4 or a.endswith("-"):
                full += 1
            else:
                fits += 1
    return full >= 2 and full >= 3 * fits


class _Title:
    """A title to find in lines, up to glyphs and case."""

    def __init__(self, title: str) -> None:
        self.text = title.lower()
        self.most = max(1, min(3, len(title) // 7))
        # An edit, a swap included, breaks two pieces at most, so one of 2 * most + 1 is whole.
        self.pieces = [piece for _, _, piece in segments(self.text, 2 * self.most)] if len(title) >= 6 else []

    def ends(self, core: str, lead: bool) -> bool:
        """Whether a line's core is the title, alone or after a short prefix; lead: any words may lead."""
        size = len(self.text)
        if not self.pieces or len(core) < size - 3:
            return False
        core = core.lower().strip()
        tail = core[-size - 2 :]
        if len(core) < size - 3:
            return False
        for piece in self.pieces:
            if piece in tail:
                break
        else:
            return False
        for n in range(size - 2, size + 3):
            rest = core[: max(0, len(core) - n)]
            if len(rest) <= 60 and (lead or not rest or re.search(r"[|:–—-]\s*$", rest)) and distance(core[-n:], self.text, self.most) <= self.most:
                return True
        return False


def _is_title(core: str, title: str, lead: bool) -> bool:
    return _Title(title).ends(core, lead)


_NUMBERED, _DOT, _STOP, _HEAD, _HEADING = re.compile(r"[\dIlO]"), re.compile(r"\d+\."), (".", ";", ","), re.compile(r"[A-Z0-9]"), re.compile(r"[A-Z0-9\"“(]")
_OTHER = re.compile(r"\d|\W|[Ss]eite|[Pp]age")
_SHOWN = frozenset("0123456789IlOoSZB|")
_WORD_OR_BAR = frozenset("_|")


def furniture(lines: list[str], title: str, source: str = "") -> dict[int, str]:
    """{line index: header or page_number}. A header is a line that is the report's title, or ends in its source's, with or
    without marking and page number, or a line that recurs beside page numbers."""
    out: dict[int, str] = {}
    cores: dict[int, str] = {}
    named, sourced = _Title(title), _Title(source)
    stripped = [x.strip() for x in lines]
    marked = any("tlp" in s.lower() for s in stripped)
    for i, s in enumerate(stripped):
        if not s:
            continue
        core = s
        ends = s[-1] if s[-1].isalnum() else next((ch for ch in reversed(s) if ch in _WORD_OR_BAR or ch.isalnum()), "")
        if ends in _SHOWN or ends == "页":  # no line with a page number at its end ends else
            if _NUMBER.match(s) and _OTHER.search(s) and _NUMBERED.search(s) and not _DOT.fullmatch(s):
                out[i] = "page_number"
                continue
        if (s[0] if s[0].isalnum() else next((ch for ch in s if ch in _WORD_OR_BAR or ch.isalnum()), "")) in _SHOWN:
            core = _WITH_NUMBER[0].sub("", core)
        if ends in _SHOWN:
            core = _WITH_NUMBER[1].sub("", core)
        if marked:
            core = _MARKING.sub("", core)
        cores[i] = core
        if not s.endswith(_STOP) and (named.ends(core, False) or _HEAD.match(core) and sourced.ends(core, True)):
            out[i] = "header"
    # Lines beside a page number, or first or last, that come again: a running line whose title is not known.
    beside: dict[str, list[int]] = defaultdict(list)
    solid = [i for i, s in enumerate(stripped) if s]
    by_number = {i for a, b in zip(solid, solid[1:]) for i, j in ((a, b), (b, a)) if out.get(j) == "page_number"}
    for i, core in cores.items():
        if (i in by_number or core != stripped[i]) and i not in out and not core.endswith(_STOP) and _HEADING.match(core):
            names = [w for w in core.split() if w[0].isalpha()]
            if 2 * sum(w[0].isupper() for w in names) < len(names):
                continue  # running text has few capitals
            beside[re.sub(r"[^a-z]", "", core.lower().replace("1", "l").replace("|", "l").replace("0", "o"))].append(i)
    for key, found in beside.items():
        if len(found) > 1 and len(key) >= 6:
            out |= dict.fromkeys(found, "header")
    return out


def _wordlike(core: str) -> bool:
    if core.isalpha() and core.isascii():  # letters only: an indicator just as the beginning of an address
        return len(core) >= 2 and not _SCHEME.match(core)
    if len(core) < 2 or _INDICATOR.search(core) or _HAN.search(core):
        return False
    letters = sum(map(str.isalpha, core))
    return letters >= 0.5 * len(core) and letters >= 1


def _impossible(word: str) -> bool:
    """Letters with a digit or symbol among them: no word reads like this."""
    return bool(re.search(r"[\d|@$!€£¢ﬁﬂﬀ]", word)) and any(ch.isalpha() for ch in word)


def body(text: str, title: str, source: str) -> tuple[list[str], bool, dict[int, str], list[tuple[int, int]]]:
    """(lines, scanned, furniture, hyphens); hyphens are (line, next line of running text) where a line ends in a hyphen."""
    lines = text.split("\n")
    if not is_scanned(lines):
        return lines, False, {}, []
    gone = furniture(lines, title, source)
    running = [i for i, x in enumerate(lines) if x.strip() and i not in gone]
    ends = [(i, j) for i, j in zip(running, running[1:]) if lines[i].rstrip()[-1] in _HYPHENS and _BROKEN.search(lines[i]) and _STARTS.match(lines[j])]
    return lines, True, gone, ends


def _break(lines: list[str], i: int, j: int) -> tuple[str, str]:
    """The two parts of a word broken at the end of line i, without surrounding punctuation."""
    return lines[i].rstrip().split()[-1].rstrip("-‐­¬").lstrip(_EDGE), lines[j].split()[0].rstrip(_EDGE)


def _signs(words: list[str], weights: dict[str, float]) -> np.ndarray:
    """A row of SIZE weighted signs for each word, from its hash."""
    bits = np.frombuffer(b"".join([xxhash.xxh3_64_digest(w) for w in words]), np.uint8).reshape(-1, 8)
    return (np.unpackbits(bits, axis=1).astype(np.float32) * 2 - 1) * np.array([weights.get(w, 1.0) for w in words], np.float32)[:, None]


def _sums(nears: list[list[str]], weights: dict[str, float]) -> np.ndarray:
    """The sum of the weighted signs of each list of words."""
    ids: dict[str, int] = {}
    flat = np.array([ids.setdefault(w, len(ids)) for words in nears for w in words], np.int64)
    out = np.zeros((len(nears), SIZE))
    some = np.flatnonzero([len(words) > 0 for words in nears])
    if len(some):
        starts = np.cumsum([0, *(len(nears[n]) for n in some[:-1])])
        out[some] = np.add.reduceat(_signs(list(ids), weights)[flat].astype(np.float64), starts, axis=0)
    return out


#: Characters of the texts that are taken apart at a time.
CHARACTERS = 8_000_000
_READ = pa.schema(
    [("key", pa.int64()), ("scanned", pa.bool_()), ("gone", pa.list_(pa.int32())), ("kinds", pa.list_(pa.string())), ("broken", pa.list_(pa.int32())), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string())), ("at", pa.list_(pa.int32())), ("cores", pa.string()), ("word", pa.string()), ("n", pa.int64())]
)


def _running(lines: list[str], gone: dict[int, str], ends: list[tuple[int, int]]) -> Iterator[tuple[int, str]]:
    """(number, line) of the lines of running text, without the parts of broken words."""
    last, first = {i for i, _ in ends}, {j for _, j in ends}
    for i, line in enumerate(lines):
        if i in gone:
            continue
        if i in last or i in first:
            parts = line.split()
            line = " ".join(parts[i in first : len(parts) - (i in last)])
        yield i, line


def _words_of(pieces: list[str]) -> tuple[np.ndarray, pa.Array]:
    """(number of the piece, word) of each word of pieces of text, without surrounding punctuation."""
    words = pc.utf8_split_whitespace(pa.array(pieces, pa.string()))
    of, cores = pc.list_parent_indices(words), pc.utf8_trim(words.flatten(), characters=_EDGE)
    kept = pc.not_equal(cores, "")
    return of.filter(kept).to_numpy(), cores.filter(kept)


def _lists(of: np.ndarray, values: pa.Array, many: int) -> pa.ListArray:
    """Values as one list for each of `many` owners, in order."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=many))]).astype(np.int32)), values)


def _taken_apart(rows: list[tuple], counts: Counter[str]) -> pa.RecordBatch:
    """Texts (key, text, title, source) as `_READ` has them; their words are added to the counts."""
    heads, pieces, owner, number = [], [], [], []
    for n, (key, text, title, source) in enumerate(rows):
        lines, scanned, gone, ends = body(text, title, source)
        if scanned:
            parts = [(i, *_break(lines, i, j)) for i, j in ends]
            heads.append((key, True, list(gone), list(gone.values()), [i for i, _, _ in parts], [a for _, a, _ in parts], [b for _, _, b in parts]))
            for i, line in _running(lines, gone, ends):
                pieces.append(line)
                owner.append(n)
                number.append(i)
        else:
            heads.append((key, False, None, None, None, None, None))
            pieces.append(text)
            owner.append(n)
            number.append(-1)
    of, cores = _words_of(pieces)
    for found in pc.value_counts(pc.utf8_lower(cores)).to_pylist():
        counts[found["values"]] += found["counts"]
    texts, at = np.array(owner, np.int64)[of], np.array(number, np.int32)[of]
    scanned = at >= 0
    columns = [pa.array(c, t) for c, t in zip(zip(*heads), _READ.types)]
    columns += [_lists(texts[scanned], pa.array(at[scanned]), len(rows)), pc.binary_join(_lists(texts, cores, len(rows)), " ")]
    return pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(rows), t) for t in _READ.types[-2:])], schema=_READ)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text read once: its furniture, its words broken in two, and its words of running text, if scanned with their lines;
    then, in rows of their own, how often each word came in a task's texts."""
    counts: Counter[str] = Counter()

    def counted() -> pa.RecordBatch:
        found = {w: n for w, n in counts.items() if _wordlike(w)}
        none = [pa.nulls(len(found), t) for t in _READ.types[:-2]]
        return pa.RecordBatch.from_arrays([*none, pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], schema=_READ)

    for batch in batches:
        held, size = [], 0
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(row)
            size += len(row[1])
            if size > CHARACTERS:
                yield _taken_apart(held, counts)
                held, size = [], 0
        if held:
            yield _taken_apart(held, counts)
        if len(counts) > AT_ONCE:
            yield counted()
            counts.clear()
    if counts:
        yield counted()


def _split(cores: str) -> list[str]:
    return cores.split(" ") if cores else []


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(different words, their numbers in order of the texts, number of the text of each) of lots of whole texts, of about half of
    CHARACTERS."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            until = CHARACTERS // 2 + (ends[start - 1] if start else 0)
            stop = max(start + 1, int(np.searchsorted(ends, until, "right")))
            lot = pc.split_pattern(pc.utf8_lower(batch.column(0).slice(start, stop - start)), " ")
            words = lot.flatten().dictionary_encode()
            yield words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(lot)), pc.list_value_length(lot).to_numpy(zero_copy_only=False))
            start = stop


def _steps(text: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which of the places have it, where it is) for each neighbour in the window, within the text."""
    for step in (x for n in range(1, WINDOW + 1) for x in (-n, n)):
        at = places + step
        has = (at >= 0) & (at < len(text))
        has[has] = text[at[has]] == text[places[has]]
        yield np.flatnonzero(has), at[has]


def _marked(marks: frozenset[int], names: list[str], seen: dict[str, bool]) -> np.ndarray:
    if len(seen) > 200_000:
        seen.clear()
    out = np.zeros(len(names), bool)
    for n, w in enumerate(names):
        if (hit := seen.get(w)) is None:
            hit = seen[w] = _mark(w) in marks
        out[n] = hit
    return out


def _learn(marks: frozenset[int], weights: dict[str, float]):
    """Partial skip-gram sums of the marked words, one row per word and HELD words of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, bool] = {}
        sums: dict[str, np.ndarray] = {}
        frame = lambda: pa.RecordBatch.from_arrays([pa.array(list(sums)), *map(pa.array, np.array(list(sums.values()), np.float64).T)], names=["word", *(f"v{k}" for k in range(SIZE))])
        for names, flat, text in _lots(batches):
            places = np.flatnonzero(_marked(marks, names, seen)[flat])
            if not len(places):
                continue
            signs = _signs(names, weights)
            words, number = np.unique(flat[places], return_inverse=True)
            pairs = np.concatenate([number[which] * len(names) + flat[at] for which, at in _steps(text, places)])
            if len(words) * len(names) <= DENSE:  # few different words: counts as a matrix
                total = np.bincount(pairs, minlength=len(words) * len(names)).reshape(len(words), len(names)).astype(np.float32) @ signs
            else:
                pairs, counts = np.unique(pairs, return_counts=True)
                total = np.zeros((len(words), SIZE), np.float32)
                for part in range(0, len(pairs), AT_ONCE):
                    some = slice(part, part + AT_ONCE)
                    mine, starts = np.unique(pairs[some] // len(names), return_index=True)
                    total[mine] += np.add.reduceat(signs[pairs[some] % len(names)] * counts[some, None].astype(np.float32), starts, axis=0)
            for n, vector in zip(words, total):
                sums[names[n]] = sums[names[n]] + vector if names[n] in sums else vector
            if len(sums) > HELD:
                yield frame()
                sums.clear()
        if sums:
            yield frame()

    return run


def variants(word: str) -> set[str]:
    """What one glyph edit, or every digit and symbol read as a letter, makes of a word."""
    low = word.lower()
    out = set()
    for shown, true in GLYPHS:
        start = low.find(shown)
        while start >= 0:
            out.add(low[:start] + true + low[start + len(shown) :])
            start = low.find(shown, start + 1)
    if _impossible(low):
        for one in ("l", "i"):
            full = low
            for shown, true in GLYPHS[:18]:
                full = full.replace(shown, one if shown in "1|!" else true)
            out.add(full)
    return out - {low}


def _variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(w, n, f) for w, n in zip(batch["word"], batch["n"]) for f in variants(w)]
        yield pd.DataFrame(rows, columns=["word", "n", "fixed"])


def _cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def read_texts(texts: DataFrame) -> DataFrame:
    """texts(key, text, title, source) as `_read` gives them, with the rows that count words."""
    return texts.select("key", "text", "title", "source").mapInArrow(
        _read, "key bigint, scanned boolean, gone array<int>, kinds array<string>, broken array<int>, left array<string>, right array<string>, at array<int>, cores string, word string, n bigint"
    )


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) of every word of texts that were read."""
    return texts.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))


def learn_vectors(texts: DataFrame, marks: frozenset[int], weights: dict[str, float]) -> DataFrame:
    """(word, vector) of the marked words, over all texts."""
    columns = [f"v{k}" for k in range(SIZE)]
    partial = texts.where("cores <> ''").select("cores").mapInArrow(_learn(marks, weights), "word string, " + ", ".join(f"{c} double" for c in columns))
    summed = partial.groupBy("word").agg(*[F.sum(c).alias(c) for c in columns])
    return summed.select("word", F.array(*columns).alias("vector"))


def _neighbours(marks: frozenset[int]):
    """(word, near, c): how often a neighbour stands beside each marked word, by lots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, bool] = {}
        for names, flat, text in _lots(batches):
            places = np.flatnonzero(_marked(marks, names, seen)[flat])
            if len(places):
                pairs = np.concatenate([flat[places[which]] * len(names) + flat[at] for which, at in _steps(text, places)])
                pairs, counts = np.unique(pairs, return_counts=True)
                named = pa.array(names)
                yield pa.RecordBatch.from_arrays([named.take(pa.array(pairs // len(names))), named.take(pa.array(pairs % len(names))), pa.array(counts.astype(np.int64))], names=["word", "near", "c"])

    return run


def _mark(word: str) -> int:
    """As Spark's xxhash64, modulo MARKS."""
    return xxhash.xxh64_intdigest(word, seed=42) & (MARKS - 1)


def _marks(words: DataFrame, *columns: str) -> frozenset[int]:
    """Hashes of the words in some columns, at most MARKS."""
    rows = words.select(F.explode(F.array(*columns)).alias("w")).select(F.xxhash64("w").bitwiseAND(F.lit(MARKS - 1)).cast("int").alias("m")).distinct()
    return frozenset(r[0] for r in rows.collect())


def _weights(words: DataFrame) -> dict[str, float]:
    """What frequent words weigh as neighbours, others 1: there are at most 1 / SAMPLE of them."""
    total = words.agg(F.sum("n")).first()[0] or 1
    return {w: (SAMPLE * total / n) ** 0.5 for w, n in words.where(F.col("n") > SAMPLE * total).select("word", "n").collect()}


def link_words(words: DataFrame, texts: DataFrame) -> DataFrame:
    """(word, fixed, n_fixed, vector) of every rare word and each frequent neighbour by a glyph edit that is used alike: the vectors
    agree, or the places of the rare word have on average a neighbour that stands beside the frequent word far beyond chance. A
    word with a digit or symbol among its letters is no word, so there the vectors only choose among what it may stand for.

    texts: what the words were counted in. Vectors are learned, and pairs counted, only of words in links, found by a hash of theirs.
    """
    edits = words.mapInPandas(_variants, "word string, n bigint, fixed string")
    frequent = words.select(F.col("word").alias("fixed"), F.col("n").alias("n_fixed"))
    odd = F.col("word").rlike(r"[\d|@$!€£¢ﬁﬂﬀ]")
    fit = F.when(odd, F.col("n_fixed") >= FREQUENT_IMPOSSIBLE).otherwise((F.col("n_fixed") >= FREQUENT) & (F.col("n_fixed") >= F.when(F.col("n") <= 2, FEW).otherwise(RATIO) * F.col("n")))
    fit = fit & ~F.col("fixed").rlike(r"[\d|@$!€£¢ﬁﬂﬀ]")
    links = stored(edits.join(frequent, "fixed").where(fit).select("word", "n", "fixed", "n_fixed", odd.alias("odd")), "candidates")
    total = words.agg(F.sum("n")).first()[0] or 1
    vectors = stored(learn_vectors(texts, _marks(links, "word", "fixed"), _weights(words)), "vectors")
    of = lambda c, v: vectors.select(F.col("word").alias(c), F.col("vector").alias(v))
    links = links.join(of("fixed", "vector"), "fixed").join(of("word", "own"), "word")
    links = stored(links.select("word", "n", "fixed", "n_fixed", "vector", (F.col("odd") | (_cosine("own", "vector") >= AGREEMENT)).alias("alike")), "compared")
    sure = links.where("alike").drop("n", "alike")
    doubt = links.where("not alike")
    marks = _marks(doubt, "word", "fixed")
    if not marks:
        return sure
    near = texts.where("cores <> ''").select("cores").mapInArrow(_neighbours(marks), "word string, near string, c bigint").groupBy("word", "near").agg(F.sum("c").alias("c"))
    near = stored(near, "neighbours")
    beside = near.select(F.col("word").alias("fixed"), "near", F.col("c").alias("c_fixed")).where(F.col("c_fixed") >= FREQUENT)
    both = doubt.select("word", "n", "fixed", "n_fixed").join(near, "word").join(beside, ["fixed", "near"]).join(words.select(F.col("word").alias("near"), F.col("n").alias("n_near")), "near")
    chance = F.col("n_fixed") * F.col("n_near") * F.lit(2.0 * WINDOW / total)
    spoken = both.where(F.col("c_fixed") >= LIFT * chance).groupBy("word", "fixed", "n").agg(F.sum("c").alias("c")).where("c >= n")
    return sure.unionByName(doubt.drop("n", "alike").join(spoken.select("word", "fixed"), ["word", "fixed"], "left_semi"))


_PLACES = pa.schema([("key", pa.int64()), ("line", pa.int32()), ("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("near", pa.list_(pa.float64()))])


def _places(marks: frozenset[int], weights: dict[str, float]):
    """The furniture and breaks of scanned texts, and the places of marked words with what their neighbours sum to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, bool] = {}
        for batch in batches:
            rows: list[tuple] = []
            words: list[tuple] = []
            nears: list[list[str]] = []
            for key, gone, kinds, broken, lefts, rights, at, cores in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(key, i, kind, "", "") for i, kind in zip(gone, kinds)]
                for i, left, right in zip(broken, lefts, rights):
                    if left and right and right.lower() not in _OPEN:
                        rows.append((key, i, "hyphen", left, right))
                shown, lows = _split(cores), _split(cores.lower())
                if len(seen) > 200_000:
                    seen.clear()
                for low in set(lows):
                    if low not in seen:
                        seen[low] = _mark(low) in marks
                for k in [k for k, low in enumerate(lows) if seen[low]]:
                    nears.append([lows[j] for j in range(max(0, k - WINDOW), min(len(lows), k + WINDOW + 1)) if j != k])
                    words.append((key, at[k], "word", shown[k], lows[k]))
            if not rows and not words:
                continue
            sums = _sums(nears, weights)
            starts = np.concatenate([np.zeros(len(rows), np.int32), np.arange(len(words) + 1, dtype=np.int32) * SIZE])
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, *words), _PLACES.types)]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(starts), pa.array(sums.ravel()))], schema=_PLACES)

    return run


def _cased(shown: str, fixed: str) -> str:
    """fixed in the case of what is shown."""
    letters = [ch for ch in shown if ch.isalpha()]
    if len(letters) > 1 and all(ch.isupper() for ch in letters):
        return fixed.upper()
    start = next((k for k, (x, y) in enumerate(zip(shown.lower(), fixed)) if x != y), min(len(shown), len(fixed)))
    tail = 0
    while tail < min(len(shown), len(fixed)) - start and shown[len(shown) - 1 - tail].lower() == fixed[len(fixed) - 1 - tail]:
        tail += 1
    out = shown[:start] + fixed[start : len(fixed) - tail] + shown[len(shown) - tail :]
    return out[:1].upper() + out[1:] if start == 0 and shown[:1].isupper() else out


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words = [_cased(a, f) for a, f in zip(batch["a"], batch["fixed"])]
        yield pd.DataFrame({"key": batch["key"], "line": batch["line"], "noise": "misread", "shown": batch["a"], "word": pd.Series(words, dtype="object", index=batch.index)})


def scan_noise(reports: DataFrame, key: str = "report_id", text: str = "report_text", title: str = "report_name", source: str = "feed_title") -> DataFrame:
    """(key, line, noise, shown, word): every noisy line (from 0) of the scanned texts. noise is header, page_number, hyphen or
    misread; shown is the word as printed (both parts with the hyphen for a break), word as it must read.

    reports: one row per key, with the title of the report and of its source. Counts and vectors are learned over all texts. Null, empty and blank texts and texts that are not
    hard-wrapped have no noise; a null title leaves headers to recurrence; other columns are not read.
    """
    name = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"\(.*?\)|\.\w{2,4}$", ""), r"-\d+$", "")
    texts = reports.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), F.trim(F.translate(name, "-_", "  ")).alias("title"), F.coalesce(source, F.lit("")).alias("source")).where(F.trim("text") != "")
    texts = stored(read_texts(texts), "read")
    words = stored(count_words(texts), "words")
    links = stored(link_words(words, texts), "links")
    places = stored(texts.where("scanned").select("key", "gone", "kinds", "broken", "left", "right", "at", "cores").mapInArrow(_places(_marks(links, "word"), _weights(words)), "key bigint, line int, kind string, a string, b string, near array<double>"), "places")

    fixed = places.where("kind = 'word'").join(links.withColumnRenamed("word", "b"), "b")
    score = _cosine("near", "vector") + F.log10("n_fixed") * 0.5
    best = fixed.groupBy("key", "line", "a", F.xxhash64("near").alias("_at")).agg(F.max_by("fixed", F.struct(score, F.col("fixed"))).alias("fixed"))
    misread = best.select("key", "line", "a", "fixed").distinct().mapInPandas(_settle, "key bigint, line int, noise string, shown string, word string")

    counts = words.select(F.col("word").alias("w"), F.col("n"))
    broken = places.where("kind = 'hyphen'").select("key", "line", "a", "b")
    forms = broken.select("*", F.explode(F.array(F.struct(F.concat("a", "b").alias("whole"), F.lit(0).alias("kept")), F.struct(F.concat_ws("-", "a", "b").alias("whole"), F.lit(1).alias("kept")))).alias("f")).select("*", "f.whole", "f.kept")
    known = forms.join(counts, F.lower("whole") == F.col("w"), "left")
    # Of two unknown forms a capital, digit or hyphen in the second part keeps the hyphen, else the word is joined.
    guess = F.when(F.col("b").rlike(r"^[A-Z0-9]") | F.col("b").contains("-") & ~F.col("b").rlike("^[a-z]+-$"), F.col("kept")).otherwise(1 - F.col("kept"))
    whole = known.groupBy("key", "line", "a", "b").agg(F.max_by("whole", F.struct(F.coalesce("n", F.lit(0)), guess)).alias("word"))
    hyphen = whole.select("key", "line", F.lit("hyphen").alias("noise"), F.concat_ws("-", "a", "b").alias("shown"), "word")
    page = places.where(F.col("kind").isin("header", "page_number")).select("key", "line", F.col("kind").alias("noise"), F.lit("").alias("shown"), F.lit("").alias("word"))
    return page.unionByName(hyphen).unionByName(misread)


def reflow(text: str, noise: list[tuple[int, str, str, str]]) -> str:
    """The text with its noise removed: furniture out, words whole and right, a line per paragraph."""
    lines = text.split("\n")
    gone = {i for i, kind, _, _ in noise if kind in ("header", "page_number")}
    for i, kind, shown, word in noise:
        if kind == "misread":
            lines[i] = re.sub(rf"(?<!\w){re.escape(shown)}(?!\w)", lambda _, w=word: w, lines[i])
    joins = {i: word for i, kind, _, word in noise if kind == "hyphen"}
    out: list[str] = []
    pending, blank, page = None, False, False
    for i, line in enumerate(lines):
        if i in gone:
            page = True
            continue
        if not line.strip():
            blank = True
            continue
        words = line.split()
        if pending is not None:
            head = out[-1].rsplit(" ", 1)
            out[-1] = (head[0] + " " if len(head) > 1 else "") + pending + re.sub(r"^[^\W_]+(?:-[^\W_]+)*", "", words[0], count=1)
            words, pending = words[1:], None
            new = False
        else:
            ended = not out or re.search(r"[.!?:…。！？][\"'”’)\]]*$", out[-1])
            new = not out or (blank and (not page or bool(ended)))
        if words:
            if new:
                out.append(" ".join(words))
            else:
                out[-1] += " " + " ".join(words)
        if i in joins:
            pending = joins[i]
        blank = page = False
    return "\n\n".join(out)


def _reflow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, noise in zip(batch["text"], batch["noise"]):
            rows = [(r["line"], r["noise"], r["shown"], r["word"]) for r in noise] if noise is not None else []
            out.append(reflow(text, rows) if rows or is_scanned(text.split("\n")) else text)
        yield pd.DataFrame({"key": batch["key"], "text": out})


def repair_scans(reports: DataFrame, key: str = "report_id", text: str = "report_text", title: str = "report_name", source: str = "feed_title") -> DataFrame:
    """(key, text): every text, the scanned ones repaired and reflowed; null texts stay out."""
    noise = scan_noise(reports, key, text, title, source)
    by = noise.groupBy("key").agg(F.collect_list(F.struct("line", "noise", "shown", "word")).alias("noise"))
    texts = reports.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where("text is not null")
    return texts.join(by, "key", "left").mapInPandas(_reflow, "key bigint, text string").withColumnRenamed("key", key)
