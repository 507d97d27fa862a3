"""Byte-level BPE over whole texts, with each distinct stretch of text encoded once.

A byte-level BPE splits a text by a pattern before it merges, and a single space between two characters
that are not white space is always such a split: a piece may begin with one space and never ends with
one. The same holds for a single line feed, which is a piece of its own. So a text may be cut there, and
equal stretches have equal ids wherever they stand. Texts repeat most of their words; the library then
sees a stretch that is remembered once instead of once for each occurrence. A text that holds the string of
a special token goes to the library whole, which gives that string the special token's id.
"""

from __future__ import annotations

import base64
import os
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of stretches and ids in one generation of a memory, of which there are two. They bound memory, not results.
KEPT_BYTES = 32 << 20
#: Longer stretches are encoded and not remembered.
MAX_KEPT_CHARS = 48
#: Stretches and gaps whose ids are put together at once.
GATHERED = 1 << 16

#: ASCII characters that are neither letters, digits nor white space.
PUNCTUATION = string.punctuation
#: What a byte is to ``cut``; letters beyond ASCII are found by their two bytes.
OTHER, LETTER, POINT, BREAK = range(4)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[list(string.ascii_letters.encode())] = LETTER
KINDS[list(PUNCTUATION.encode())] = POINT
KINDS[list(b" \n")] = BREAK


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


def _strings(values: pa.Array, these: np.ndarray) -> list[str]:
    return values.filter(pa.array(these)).to_numpy(zero_copy_only=False).tolist()


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts at every space and line feed into stretches, and split plain ones.

    Gives strings that are by turns a stretch and the gap up to the next; the number of each text's last
    stretch; whether a stretch is plain, letters and then perhaps punctuation, which belongs to the gap;
    and whether it has no space before it. A gap ends with the byte it was cut at, zero at a text's end.
    Letters are those below U+0250, which are letters in every version of Unicode that the libraries use.
    """
    closed = pc.binary_join_element_wise(texts.cast(pa.large_string()), *pa.array(["", "\0"], pa.large_string()))
    offsets = np.frombuffer(closed.buffers()[1], np.int64)[closed.offset :][: len(closed) + 1]
    data = np.frombuffer(closed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets[1:] - offsets[0] - 1
    kinds = KINDS[data]
    kinds[ends] = BREAK
    at = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))
    a, b = data[at], data[at + 1]
    at = at[(a >= 0xC3) & (a <= 0xC8) & ((a > 0xC3) | (b != 0x97) & (b != 0xB7)) | (a == 0xC9) & (b <= 0x8F) | (a == 0xC2) & ((b == 0xAA) | (b == 0xB5) | (b == 0xBA))]
    kinds[at] = kinds[at + 1] = LETTER
    breaks = np.flatnonzero(kinds == BREAK)
    begins = np.concatenate([[0], breaks[:-1] + 1])
    turns = np.flatnonzero(np.diff(kinds == LETTER, prepend=False))  # no text ends with a letter, but with its zero
    froms, tos = turns[::2], turns[1::2]
    is_begin = np.equal(kinds[froms - 1], BREAK)
    is_begin[:1] |= froms[:1] == 0
    is_plain = kinds[begins] == LETTER
    stems = breaks.copy()
    stems[is_plain] = tos[is_begin]
    is_plain[np.searchsorted(breaks, np.flatnonzero(kinds == OTHER))] = False
    is_plain[np.searchsorted(breaks, froms[~is_begin])] = False
    bounds = np.empty(2 * len(breaks) + 1, np.int64)
    bounds[:-1:2], bounds[1::2], bounds[-1] = begins, np.where(is_plain, stems, breaks), len(data)
    tiles = pa.LargeStringArray.from_buffers(2 * len(breaks), pa.py_buffer(bounds), pa.py_buffer(data))
    is_first = np.concatenate([[True], data[breaks[:-1]] != ord(" ")])
    return tiles, np.searchsorted(breaks, ends), is_plain, is_first


class Memory:
    """Ids of stretches, in two generations: what is not asked for again while a generation fills is forgotten."""

    def __init__(self, limit: int = KEPT_BYTES):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size, self.limit = 0, limit

    def age(self) -> None:
        """Between steps: a full generation becomes the old one."""
        if self.size >= self.limit:
            self.young, self.old, self.size = {}, self.young, 0

    def get(self, stretch: str) -> bytes | None:
        if (v := self.young.get(stretch)) is None and (v := self.old.get(stretch)) is not None:
            self.put(stretch, v)
        return v

    def get_all(self, stretches: list[str]) -> list[bytes | None]:
        values = list(map(self.young.get, stretches))
        if self.old:
            missing = [i for i, v in enumerate(values) if v is None]
            for i, v in zip(missing, map(self.old.get, [stretches[i] for i in missing]), strict=True):
                values[i] = v
            self.put_all(stretches, values, [i for i in missing if values[i] is not None])
        return values

    def put_all(self, stretches: list[str], values: list[bytes | None], these: list[int]) -> None:
        """As ``put`` for each of ``these`` in turn."""
        young, size, limit = self.young, self.size, self.limit
        for i in these:
            if size >= limit:
                break
            if (n := len(p := stretches[i])) <= MAX_KEPT_CHARS:
                young[p] = v = values[i]
                size += 4 * n + len(v) + 190
        self.size = size

    def put(self, stretch: str, ids: bytes) -> None:
        if self.size < self.limit and len(stretch) <= MAX_KEPT_CHARS:
            self.size += 4 * len(stretch) + len(ids) + 190  # 190: two objects and a place in the dictionary
            self.young[stretch] = ids


class CachedEncoder:
    """Encodes texts to ids by ``tokenizer``, a byte-level BPE of the ``tokenizers`` library."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.inner = Memory()  # a stretch after a space -> its ids, with the space
        self.head = Memory()  # a stretch at the start of a text or a line
        self.tail = Memory()  # a run of punctuation after a letter
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.feed = self._direct(["\n"])[0]
        self.letters = byte_alphabet()
        self.id_bytes = [n.to_bytes(4, "little") for n in range(tokenizer.get_vocab_size() + 1)]

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], known: Memory, lead: str) -> np.ndarray:
        """Ids of words of letters: the bytes of an unknown one go as characters straight to the merges."""
        values = known.get_all(words)
        tokenize, as_bytes, letters = self.model.tokenize, self.id_bytes, self.letters
        spelled_lead = letters[ord(" ")] if lead else ""
        missing = [i for i, v in enumerate(values) if v is None]
        for i in missing:
            p = words[i]
            found = tokenize(spelled_lead + (p if p.isascii() else p.encode().decode("latin-1").translate(letters)))
            values[i] = as_bytes[found[0].id] if len(found) == 1 else b"".join([as_bytes[t.id] for t in found])
        known.put_all(words, values, missing)
        return _objects(values)

    def _others(self, stretches: list[str], known: Memory, lead: str) -> np.ndarray:
        """Ids of other stretches; None for one that may not be cut off at its ends."""
        values = [known.get(p) for p in stretches]
        rest = [i for i, (p, v) in enumerate(zip(stretches, values, strict=True)) if v is None and p and not (p[0].isspace() or p[-1].isspace())]
        for i, v in zip(rest, self._direct([lead + stretches[i] for i in rest]) if rest else (), strict=True):
            values[i] = v
            known.put(stretches[i], v)
        return _objects(values)

    def _gaps(self, gaps: list[str]) -> np.ndarray:
        """Ids of what lies between words: a run of punctuation that ends a word, and a line feed."""
        out = []
        for gap in gaps:
            v = b""
            if (run := gap[:-1]) and (v := self.tail.get(run)) is None:
                v = self._direct([run])[0]
                self.tail.put(run, v)
            out.append(v + self.feed if gap[-1] == "\n" else v)
        return _objects(out)

    def _whole(self, text: str) -> bytes:
        """A text with runs of white space: cut only where both sides of a space are closed."""
        out, run = [], ""
        for i, p in enumerate(text.split(" ")):
            if i and run and p and not run[-1].isspace() and not p[0].isspace():
                out.append(run)
                run = " " + p
            else:
                run = f"{run} {p}" if i else p
        return b"".join(self._direct([*out, run] if run else out))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` (strings without nulls), end to end, and where each text's begin."""
        for memory in (self.inner, self.head, self.tail):
            memory.age()
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        tiles, lasts, is_plain, is_first = cut(texts)
        coded = tiles.dictionary_encode()
        names, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).copy()
        del tiles, coded
        n = len(names)
        plain = np.zeros(n, bool)
        plain[index[::2][is_plain]] = True
        index[::2] += n * is_first  # a stretch without a space before it is another one
        index[1::2] += 2 * n  # and so is a gap
        used = np.zeros(3 * n, bool)
        used[index] = True
        values = np.full(3 * n, b"", object)
        for kind, known, lead in ((0, self.inner, " "), (1, self.head, "")):
            here = slice(kind * n, kind * n + n)
            for find, these in ((self._words, used[here] & plain), (self._others, used[here] & ~plain)):
                values[here][these] = find(_strings(names, these), known, lead)
        values[2 * n :][used[2 * n :]] = self._gaps(_strings(names, used[2 * n :]))
        is_open = np.equal(values, None)
        begins = np.concatenate([[0], lasts[:-1] + 1])
        empty = pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0
        whole = np.logical_or.reduceat(is_open[index[::2]], begins) & ~empty
        special = np.zeros(len(texts), bool)
        for token in self.special:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        by_hand = np.flatnonzero(whole | special)
        values[is_open] = b""
        sizes, own = np.zeros(3 * n, np.int32), values[used]
        sizes[used] = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat = np.frombuffer(b"".join(own), dtype="<u4")
        froms, counts = np.cumsum(sizes, dtype=np.int64) - sizes, sizes[index]
        bounds = np.concatenate([[0], np.cumsum(np.add.reduceat(counts, 2 * begins, dtype=np.int64))])
        ids, at = np.empty(bounds[-1], "<u4"), 0
        for i in range(0, len(index), GATHERED):
            n_ids = counts[i : i + GATHERED]
            ends = np.cumsum(n_ids, dtype=np.int64)
            ids[at : at + ends[-1]] = flat[np.repeat(froms[index[i : i + GATHERED]] - ends + n_ids, n_ids) + np.arange(ends[-1])]
            at += ends[-1]
        if not len(by_hand):
            return ids, bounds
        parts = [ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        for i in by_hand.tolist():
            text = texts[i].as_py()
            parts[i] = np.frombuffer(self._direct([text])[0] if special[i] else self._whole(text), dtype="<u4")
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def encode_list(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, bounds = self.encode(pa.array(texts, pa.large_string()))
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


#: Bytes of text encoded at once: bounds the memory of the working arrays.
STEP_BYTES = 4 << 20


def text_steps(texts: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a column into runs of rows with about ``step`` bytes each; a longer row stands alone."""
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float))
    begin, total = 0, 0.0
    for i, n in enumerate(sizes):
        if i > begin and total + n > step:
            yield begin, i
            begin, total = i, 0.0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on."""
    same = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in same}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def tokenizer_from_ranks(ranks: dict[bytes, int], pattern: str):
    """A ``tokenizers.Tokenizer`` that encodes like byte-pair merging by rank.

    Bytes become characters of ``byte_alphabet``. Any two neighbours whose bytes together have a rank
    may merge there, so every way to split a token into two others is a merge, in order of rank.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    alphabet = byte_alphabet()
    spell = {token: "".join(alphabet[b] for b in token) for token in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        merges += [(spell[token[:i]], spell[token[i:]]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    model = models.BPE(vocab={spell[token]: rank for token, rank in ranks.items()}, merges=merges, ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer


_encoders: dict[tuple, CachedEncoder] = {}


def json_encoder(path: str) -> CachedEncoder:
    """The encoder of a tokenizer file, one for each Python worker."""
    key = ("json", path)
    if key not in _encoders:
        from tokenizers import Tokenizer

        _encoders[key] = CachedEncoder(Tokenizer.from_file(path))
    return _encoders[key]


def forget() -> None:
    """Let go of the encoders, which a Python worker keeps from task to task, in a stage that has no use for them."""
    _encoders.clear()


def ranks_encoder(path: str, pattern: str) -> CachedEncoder:
    """The encoder of a rank file, one for each Python worker."""
    key = ("ranks", path, pattern)
    if key not in _encoders:
        _encoders[key] = CachedEncoder(tokenizer_from_ranks(read_ranks(path), pattern))
    return _encoders[key]
