"""Token counts of every prefix of a text, by dynamic programming over prefixes, for a BPE with word ends.

The encoding of a prefix is that of a shorter one and one more token: of all vocabulary tokens that end there, the one
that fits after the last token of the prefix it leaves (two tokens fit if merging their letters gives these two back).
So a word needs a last token and a count for each of its prefixes, and a closed count for the case that the text ends
there; counts of texts are running sums over words. One stored array answers how many tokens any prefix has and which
is the longest one within a budget; nothing is encoded again.

The file's normaliser (composition, white space, lower case), its pattern and its added tokens are followed: an added
token in a text counts as one, and a prefix that ends within it holds its letters as plain text. Pieces between white
space are counted once per worker while they stay in a bounded memo.

Defined cases: a null text is empty and has no tokens; a prefix that ends within a composed character (a letter before
its combining accent) has no count, -1; white space has no tokens; long runs without white space take time in
proportion to their length; rows, repeated or not, are independent; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .bpe import byte_chars
from .common import KEPT, lean_batches, pack, unpack, without

#: The published pattern that splits text into words, what it takes for white space, and letters whose lower case is
#: newer than this Python's tables (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
SPACE = [chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
LOWER = {"\ua7cb": "\u0264", "\ua7dc": "\u019b"} | {chr(c): chr(c + 32) for c in range(0x10D50, 0x10D66)}
END = "</w>"
#: What a byte holds where there is no count, and marks that often end a piece.
NONE, MARKS = 255, ",.;:!?"
Held = bytes | np.ndarray
#: Pieces and words that a worker remembers, the longest one that it does, and pairs of tokens.
MEMO, MEMO_CHARS, PAIRS = 900_000, 64, 2_000_000
#: Bytes of text whose new pieces are learnt together.
LOT = 8 << 20


class Prefixes:
    """Counts of all prefixes of words, pieces and texts under one vocabulary."""

    def __init__(self, spec: bytes) -> None:
        made = json.loads(spec)
        if made["model"].get("end_of_word_suffix") != END:
            raise ValueError("a vocabulary with word ends is needed")
        self.chars = byte_chars()
        self.rank: dict[tuple[str, str], int] = {}
        #: Symbols at a token's left and right edge, the token itself first, with the rank of the merge that made each.
        self.left: dict[str, list[tuple[str, int]]] = {}
        self.right: dict[str, list[tuple[str, int]]] = {}
        for c in self.chars:
            for t in (c, c + END):
                self.left[t] = self.right[t] = [(t, -1)]
        for i, pair in enumerate(made["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[a, b] = i
            if a + b in self.left:
                raise ValueError("two merges make the same token")
            if a in self.left and b in self.left and self.apart(a, b, i):  # else its letters never become this token
                self.left[a + b] = [(a + b, i), *self.left[a]]
                self.right[a + b] = [(a + b, i), *self.right[b]]
        #: Every ending of a token's letters: the token it is within a word, and the one that it is at the end.
        self.endings: dict[str, tuple[str | None, str | None]] = {}
        for t in self.left:
            letters = t.removesuffix(END)
            for n in range(1, len(letters) + 1):
                self.endings.setdefault(letters[-n:], (None, None))
            within, end = self.endings[letters]
            self.endings[letters] = (within, t) if t.endswith(END) else (t, end)
        self.added = [t["content"] for t in made["added_tokens"]]
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None
        self.words = regex.compile(PATTERN).findall
        self.pairs: dict[tuple[str, str], bool] = {}
        self.word_memo: dict[str, Sequence[int]] = {}
        self.piece_memo: dict[str, Held] = {"": bytes(1)}

    def apart(self, a: str, b: str, until: int) -> bool:
        """Whether no merge across the edge of a and b comes before they are whole, or after that and before rank until.

        Symbols at the edge are taken apart from the latest merge to the first; of equal ranks the left one comes first.
        """
        rank, left, right = self.rank, self.right[a], self.left[b]
        i = j = 0
        end_a = end_b = until
        while True:
            (x, made_x), (y, made_y) = left[i], right[j]
            m = rank.get((x, y))
            if m is not None and m < end_a and (m < end_b or (m == end_b and j)):
                return False
            if made_x < 0 and made_y < 0:
                return True
            if made_x > made_y:
                i, end_a = i + 1, made_x
            else:
                j, end_b = j + 1, made_y

    def fits(self, before: str, token: str) -> bool:
        """Whether before and token stay as they are when their letters are merged."""
        known = self.apart(before, token, len(self.rank))
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[before, token] = known
        return known

    def learn_words(self, words: set[str]) -> dict[str, Sequence[int]]:
        """Tokens of word[:1], word[:2], ..., each as a word that ends there, for every word.

        Words go in order of their letters, so that each goes on from the prefix that it shares with the one before.
        """
        chars, endings, pairs, fits = self.chars, self.endings, self.pairs, self.fits
        out, old = {}, ""
        last, count, closed = [""], [0], [0]
        for text, word in sorted(("".join([chars[b] for b in w.encode()]), w) for w in words):
            m, n = 0, len(text)
            for x, y in zip(old, text, strict=False):
                if x != y:
                    break
                m += 1
            del last[m + 1 :], count[m + 1 :], closed[m + 1 :]
            for p in range(m + 1, n + 1):
                found = ended = 0
                token = ""
                for q in range(p - 1, -1, -1):
                    got = endings.get(text[q:p])
                    if got is None:
                        break
                    within, end = got
                    before = last[q]
                    if within is not None and not found:
                        fine = pairs.get((before, within)) if q else True
                        if fine or (fine is None and fits(before, within)):
                            found, token = count[q] + 1, within
                            if ended:
                                break
                    if end is not None and not ended:
                        fine = pairs.get((before, end)) if q else True
                        if fine or (fine is None and fits(before, end)):
                            ended = count[q] + 1
                            if found:
                                break
                last.append(token)
                count.append(found)
                closed.append(ended)
            raw = word.encode() if n != len(word) else b""
            made = [closed[p] for p in range(1, n + 1) if p == n or raw[p] & 0xC0 != 0x80] if raw else closed[1:]
            out[word] = bytes(made) if n <= 255 else made
            old = text
        return out

    def word(self, word: str) -> Sequence[int]:
        made = self.word_memo.get(word)
        return made if made is not None else self.learn_words({word})[word]

    def counts_of(self, words: list[str]) -> list[int]:
        """Tokens of each prefix of the words written one after the other."""
        out, base = [], 0
        for word in words:
            counts = list(self.word(word))
            if len(word) > 1 and word[0] == "'" and word[1].isalpha():  # within 're the quote and the r are words
                quote = self.word("'")[0]
                counts = [quote, *(quote + c for c in self.word(word[1:])[:-1]), counts[-1]]
            out += [base + c for c in counts] if base else counts
            base = out[-1]
        return out

    def learn(self, pieces: list[str]) -> dict[str, Held]:
        """For each piece: tokens of piece[:1], piece[:2], ..., and with a space after it; a byte each (NONE within a
        composed character), or 32-bit integers (-1) where bytes don't hold them."""
        plain, marked, others = [], [], []
        for piece in pieces:
            if piece.isascii() or (unicodedata.is_normalized("NFC", piece) and max(piece) < "\ua7ca" and "Σ" not in piece):
                low = piece.lower()
                if len(low) == len(piece):
                    if low.isalpha():
                        plain.append((piece, low))
                    elif low[-1] in MARKS and low[:-1].isalpha():
                        marked.append((piece, low[:-1], low[-1]))
                    else:
                        others.append((piece, None, self.words(low)))
                    continue
            clusters = [*piece] if unicodedata.is_normalized("NFC", piece) else composed(piece)
            lower = ["".join([LOWER.get(c) or c.lower() for c in unicodedata.normalize("NFC", x)]) for x in clusters]
            others.append((piece, (clusters, lower), self.words("".join(lower))))
        if len(self.word_memo) > MEMO:
            self.word_memo.clear()
        memo = self.word_memo
        asked = {x[1] for x in plain} | {w for x in marked for w in x[1:]} | {w for x in others for w in x[2]}
        made = self.learn_words({w for w in asked if w not in memo})
        memo.update(made)
        out: dict[str, Held] = {}
        for piece, word in plain:
            counts = memo[word]
            out[piece] = counts + counts[-1:] if type(counts) is bytes and counts[-1] < NONE else np.array([*counts, counts[-1]], np.int32)
        for piece, word, mark in marked:
            counts = memo[word]
            total = counts[-1] + memo[mark][-1]
            out[piece] = counts + bytes((total, total)) if type(counts) is bytes and total < NONE else np.array([*counts, total, total], np.int32)
        for piece, parts, words in others:
            counts = self.counts_of(words)
            counts.append(counts[-1])
            if parts is not None:
                clusters, lower = parts
                held = np.full(len(piece) + 1, -1, np.int32)
                held[np.cumsum([len(x) for x in clusters]) - 1] = np.array(counts, np.int32)[np.cumsum([len(x) for x in lower]) - 1]
                held[-1] = counts[-1]
                counts = held.tolist()
            out[piece] = bytes([c if c >= 0 else NONE for c in counts]) if counts[-1] < NONE and max(counts) < NONE else np.array(counts, np.int32)
        for word in [w for w in made if len(w) > MEMO_CHARS]:
            del memo[word]
        return out

    def piece(self, piece: str) -> Held:
        got = self.piece_memo.get(piece)
        return self.learn([piece])[piece] if got is None else got

    def prepare(self, texts: list[str]) -> None:
        """Learns the new pieces of some texts together (long ones are left to their text)."""
        memo = self.piece_memo
        new = {p for t in texts for p in blanks(t).split(" ") if p not in memo}
        if len(memo) + len(new) > MEMO:
            memo.clear()
            memo[""] = bytes(1)
            new = {p for t in texts for p in blanks(t).split(" ") if p}
        memo.update(self.learn([p for p in new if len(p) <= MEMO_CHARS]))

    def plain(self, text: str) -> np.ndarray:
        """Tokens of each prefix of one character or more, added tokens being plain text."""
        memo = self.piece_memo
        pieces = blanks(text).split(" ")
        got = [memo[p] if p in memo else self.piece(p) for p in pieces]
        if all([type(g) is bytes for g in got]):
            inner = np.frombuffer(b"".join(got), np.uint8).astype(np.int32)
            inner[inner == NONE] = -1
        else:
            wide = [np.frombuffer(g, np.uint8).astype(np.int32) if type(g) is bytes else g for g in got]
            inner = np.concatenate([np.where(w == NONE, -1, w) if type(g) is bytes else w for g, w in zip(got, wide, strict=True)])
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        total = inner[np.cumsum(size) - 1]
        base = np.repeat(np.cumsum(total, dtype=np.int32) - total, size)[:-1]
        inner = inner[:-1]
        return np.where(inner < 0, -1, inner + base) if len(inner) and inner.min() < 0 else inner + base

    def counts(self, text: str) -> np.ndarray:
        """Tokens of text[:0], text[:1], ..., text."""
        parts = self.special(text) if any(t in text for t in self.added) else [text]
        out, base = [np.zeros(1, np.int32)], 0
        for i in range(0, len(parts), 2):
            added = parts[i + 1] if i + 1 < len(parts) else ""
            inner = self.plain(parts[i] + added[:-1])
            own = int(inner[len(parts[i]) - 1]) if parts[i] else 0
            out.append(np.where(inner < 0, -1, inner + base).astype(np.int32) if base else inner)
            base += own
            if added:
                base += 1
                out.append(np.array([base], np.int32))
        return np.concatenate(out)


def blanks(text: str) -> str:
    """text with every white space as a space."""
    for c in SPACE:
        if c in text and c != " ":
            text = text.replace(c, " ")
    return text


def in_lots(batches: Iterator[pa.RecordBatch], at: int, model: Prefixes) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of batches with their texts (null: empty), whose pieces the model has learnt."""
    for rb in batches:
        size = pc.fill_null(pc.binary_length(rb.column(at)), 0).to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.diff(np.cumsum(size) // LOT, prepend=0)).tolist()
        for i, j in zip([0, *edge], [*edge, rb.num_rows], strict=True):
            if i < j:
                some = rb.slice(i, j - i)
                texts = [t or "" for t in some.column(at).to_pylist()]
                model.prepare(texts)
                yield some, texts


_SECOND: set[str] = set()


def composed(piece: str) -> list[str]:
    """piece in parts that compose each for itself: cut before characters that no earlier one composes or is ordered with."""
    if not _SECOND:
        pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
        _SECOND.update(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<")
        _SECOND.update(chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)])  # vowels and finals of syllables
    out: list[list[str]] = []
    for c in piece:
        first = unicodedata.normalize("NFD", c)[0]
        if out and (unicodedata.combining(first) or first in _SECOND):
            out[-1].append(c)
        else:
            out.append([c])
    return ["".join(x) for x in out]


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most budget tokens (counts may fall where a longer token begins to match)."""
    return int(np.flatnonzero((counts >= 0) & (counts <= budget))[-1]) if budget >= 0 else 0


def _model(sent) -> Prefixes:
    """This worker's model, kept between tasks."""
    spec = sent.value
    key = hashlib.sha256(b"prefixes" + spec).digest()
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = Prefixes(spec)
    return KEPT[key]


def _send(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _with(df: DataFrame, path: str, text_col: str, out: str, kind: str, arrow: pa.DataType, f) -> DataFrame:
    """df with out: f(text, counts of its prefixes)."""
    df = without(df, out)
    sent, names = _send(df, path), df.columns
    at = [n.lower() for n in names].index(text_col.lower())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent)
        for rb, texts in in_lots(batches, at, model):
            made = [f(t, model.counts(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(made, arrow)], [*names, out])

    fields = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in df.schema.fields)
    return df.mapInArrow(lean_batches(rows, keep=True), f"{fields}, `{out}` {kind}")


def prefix_counts(df: DataFrame, path: str, text_col: str = "text", out: str = "prefix_tokens") -> DataFrame:
    """df with the token counts of text[:0], text[:1], ... as array<int>."""
    return _with(df, path, text_col, out, "array<int>", pa.list_(pa.int32()), lambda _, c: c)


def truncate(df: DataFrame, path: str, budget: int, text_col: str = "text", out: str = "within") -> DataFrame:
    """df with the longest prefix of the text that has at most budget tokens."""
    return _with(df, path, text_col, out, "string", pa.string(), lambda t, c: t[: longest_within(c, budget)])


def store_counts(df: DataFrame, path: str, text_col: str = "text", out: str = "prefixes") -> DataFrame:
    """df with the same counts packed (their differences, compressed), to be kept beside the texts."""
    return _with(df, path, text_col, out, "binary", pa.binary(), lambda _, c: pack(np.diff(c, prepend=np.int32(0))))


def stored(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob)[0], dtype=np.int32)


def ask_budgets(df: DataFrame, budgets: list[int], blob_col: str = "prefixes", out: str = "fits") -> DataFrame:
    """df with, for each budget, the characters of the longest prefix within it; reads stored counts alone."""
    df = without(df, out)
    names = df.columns
    at = [n.lower() for n in names].index(blob_col.lower())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            made = [[longest_within(c, b) for b in budgets] for c in (stored(x.as_py()) for x in rb.column(at))]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(made, pa.list_(pa.int64()))], [*names, out])

    fields = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in df.schema.fields)
    return df.mapInArrow(lean_batches(rows), f"{fields}, `{out}` array<long>")


def token_counts(df: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit): the count of the longest prefix, the whole text."""
    sent = _send(df, path)
    kept = df.select(df[id_col], df[text_col].cast("string"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent)
        for rb, texts in in_lots(batches, 1, model):
            n = np.array([model.counts(t)[-1] for t in texts], np.int64)
            size = pc.fill_null(pc.binary_length(rb.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([rb.column(0), size, pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return kept.mapInArrow(lean_batches(rows, keep=True), f"`{id_col}` {kept.dtypes[0][1]}, n_bytes long, n_tokens long, over_limit boolean")
