"""Public BPE vocabularies applied to whole texts: exact, with memoised pieces.

Texts come in batches: what a batch holds anew is encoded together, each distinct piece once, by the
tokenizers library. The memos are bounded (common.Memo).
"""

from __future__ import annotations

import base64
import re
import struct
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer, models, pre_tokenizers

from ferrule.llm.common import Memo


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordBpe:
    """The word-end BPE: text -> little-endian 32-bit ids, equal to Tokenizer.encode(text, add_special_tokens=False).

    White space never joins a token's pieces with its neighbours, so a text is cut there. A text that may hold
    the string of a special token goes to the library as it is.
    """

    #: Printable ASCII and the letters of Latin-1: already composed, lower-cased alike everywhere; and line feeds between words.
    PLAIN = re.compile("[\n!-~À-ÖØ-öø-ÿ]*")
    PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^0-9a-zß-öø-ÿ\n]+")
    #: Between words; no id has a high half of ones.
    GAP = b"\xff\xff\xff\xff"

    def __init__(self, path: str, memo: int = 250_000):
        self.full = Tokenizer.from_file(path)
        #: How special tokens begin; a text with such characters is not cut.
        self.special = sorted({t.content[:2] for t in self.full.get_added_tokens_decoder().values()})
        self.model = self.full.model
        alphabet = byte_alphabet()
        self.shown = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in range(0xA1, 0x100)}
        self.pieces = Memo(self._pieces, memo)

    def forget(self) -> None:
        self.pieces.forget()

    def _library(self, text: str) -> bytes:
        ids = self.full.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        out, tokenize = [], self.model.tokenize
        for piece in pieces:
            ids = [t.id for t in tokenize(piece if piece.isascii() else piece.translate(self.shown))] if piece != "\n" else [0xFFFFFFFF]
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    def _words(self, joined: str) -> list[bytes]:
        """The ids of each of the words, which are separated by line feeds."""
        if self.PLAIN.fullmatch(joined):
            return b"".join(self.pieces(self.PIECE.findall(joined.lower()))).split(self.GAP)
        words = joined.split("\n")
        plain = [w for w in words if self.PLAIN.fullmatch(w)]
        known = dict(zip(plain, self._words("\n".join(plain)), strict=True)) if plain else {}
        return [known[w] if w in known else self._library(w) for w in words]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's begin, and the end)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        # a cut at other white space than ASCII's isn't needed: the library cuts such words itself
        cut = pc.ascii_split_whitespace(texts)
        found = [pc.match_substring(texts, s) for s in self.special]
        if any(pc.any(mask).as_py() for mask in found):
            return self._with_special(texts, np.any([mask.to_numpy(zero_copy_only=False) for mask in found], axis=0))
        flat = cut.flatten().dictionary_encode()
        if not len(flat):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        values = self._words(pc.binary_join(pa.ListArray.from_arrays([0, len(flat.dictionary)], flat.dictionary), "\n")[0].as_py())
        table = np.frombuffer(b"".join(values), "<u4")
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        first, codes = np.cumsum(size) - size, flat.indices.to_numpy()
        lengths = size[codes]
        ends = np.append(0, np.cumsum(lengths))
        ids = table[np.repeat(first[codes] - ends[:-1], lengths) + np.arange(ends[-1])]
        return ids, ends[np.append(0, np.cumsum(pc.list_value_length(cut).to_numpy()))]

    def _with_special(self, texts: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, ends = self.encode_column(pa.array([None if w else t for t, w in zip(texts.to_pylist(), whole.tolist(), strict=True)], pa.string()))
        own = [np.frombuffer(self._library(t), "<u4") if w else ids[a:b] for t, w, a, b in zip(texts.to_pylist(), whole.tolist(), ends, ends[1:], strict=False)]
        return np.concatenate(own), np.append(0, np.cumsum([len(x) for x in own]))

    def encode(self, text: str | None) -> bytes:
        return self.encode_column(pa.array([text], pa.string()))[0].tobytes()


class ByteBpe:
    """Byte-level BPE by a rank file, run by the tokenizers library.

    Every cut of a token into two tokens is a merge of that token's rank, so the library merges
    the pair of lowest joint rank first, as the rank file asks. Each distinct match of the pattern is
    encoded once and kept as (its ids as decimal text, the bytes that the ids decode to).
    """

    #: The classes of the public pattern for text of Latin-1 characters only, where they can be listed.
    LATIN = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ÿ", r"\p{N}": "0-9²³¹¼½¾", r"\s": r"\t-\r \x85\xa0"}

    def __init__(self, path: str, pattern: str, memo: int = 120_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.alphabet = byte_alphabet()
        show = lambda token: "".join(self.alphabet[b] for b in token)
        merges = []
        for token in sorted(self.ranks, key=self.ranks.get):
            cuts = ((token[:i], token[i:]) for i in range(1, len(token)))
            merges += [(show(a), show(b)) for a, b in cuts if a in self.ranks and b in self.ranks]
        self.model = models.BPE(vocab={show(t): i for t, i in self.ranks.items()}, merges=merges)
        #: The byte table reversed: id -> bytes; a character's bytes may lie in several ids.
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for t, i in self.ranks.items():
            self.bytes_of[i] = t
        self.shown = dict(enumerate(self.alphabet))
        self.pattern = regex.compile(pattern)
        self.latin = self._latin(pattern)
        self.pieces = Memo(self._pieces, memo)
        self.pre = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def _latin(self, pattern: str) -> re.Pattern | None:
        """The same pattern with its classes listed, for Python's own engine; None if it has others."""
        inner = re.sub(r"\[(.*?)\]", lambda m: "[" + self._listed(m[1]) + "]", pattern)
        parts = re.split(r"(\[.*?\])", inner)
        listed = "".join(x if x.startswith("[") else re.sub(r"\\p\{[LN]\}|\\s|\\S", lambda m: f"[^{self.LATIN[chr(92) + 's']}]" if m[0] == r"\S" else f"[{self.LATIN[m[0]]}]", x) for x in parts)
        return None if re.search(r"\\[pPSwWdDbB]", listed) else re.compile(listed)

    def _listed(self, inside: str) -> str:
        for name, chars in self.LATIN.items():
            inside = inside.replace(name, chars)
        return inside

    def forget(self) -> None:
        self.pieces.forget()

    def split(self, text: str) -> list[str]:
        """The matches of the pattern."""
        if self.latin is not None and (text.isascii() or not LARGE.search(text)):
            return self.latin.findall(text)
        return self.pattern.findall(text)

    def ids(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))]

    def _pieces(self, pieces: list[str]) -> list[tuple[str, bytes]]:
        out = []
        for piece in pieces:
            ids = self.ids(piece)
            out.append((",".join(map(str, ids)), self.decode(ids)))
        return out

    def encode(self, text: str) -> list[int]:
        return [i for p in self.split(text) for i in self.ids(p)]

    def encode_column(self, texts: pa.Array) -> tuple[list[str], list[bytes]]:
        """For each text its ids as decimal text, joined by commas, and the bytes that they decode to."""
        split = [self.split(t) if t else [] for t in texts.to_pylist()]
        flat = pa.array(list(chain.from_iterable(split)), pa.string()).dictionary_encode()
        ends = pa.array([0, *accumulate(map(len, split))], pa.int32())
        coded, raw = zip(*self.pieces(flat.dictionary.to_pylist()), strict=True) if len(flat) else ((), ())
        lists = lambda values, kind: pa.ListArray.from_arrays(ends, pa.array(values, kind).take(flat.indices))
        return pc.binary_join(lists(coded, pa.string()), ",").to_pylist(), pc.binary_join(lists(raw, pa.binary()), b"").to_pylist()

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) in characters; an id that starts or ends inside a character covers that whole character."""
        starts = [i for i, c in enumerate(text) for _ in c.encode()]
        out, at = [], 0
        for i in self.encode(text):
            n = len(self.bytes_of[i])
            out.append((i, starts[at], starts[at + n - 1] + 1))
            at += n
        return out


LARGE = re.compile("[^\x00-\xff]")
