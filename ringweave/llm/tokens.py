"""Token ids of whole texts by a file of the ``tokenizers`` library, with a bounded memory of pieces."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

#: Letters of the scripts for which the split below is known to be the tokenizer's own.
_LATIN = "a-zA-ZªµºÀ-ÖØ-öø-ɏ"
#: The public split pattern of byte-level BPE, restated for texts of ASCII and Latin letters.
_SPLIT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\t-\r 0-9{_LATIN}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
_OTHER = re.compile(rf"[^\x00-\x7f{_LATIN}]")
_CUT = re.compile(r"\S (?=\S)")
#: Pieces remembered for each worker, and their characters. Beyond either, those met again stay, up to half as many.
PIECES, PIECE_CHARS = 700_000, 12_000_000


class _Numbers(dict):
    """A number for each piece; pieces not seen before get the next ones, and are noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class _Rows:
    """Arrays end to end, as one array that grows."""

    def __init__(self, dtype):
        self.data, self.n = np.empty(1 << 16, dtype=dtype), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            own = np.empty(max(2 * len(self.data), self.n + len(more)), dtype=self.data.dtype)
            own[: self.n] = self.data[: self.n]
            self.data = own
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class TextEncoder:
    """Ids of whole texts, equal to those of ``encode(text, add_special_tokens=False)``.

    A byte-level BPE never merges across the pieces its pattern splits off, so the ids of a text are
    those of its pieces in order. The library encodes each distinct piece once and its ids are
    remembered. Texts with characters for which this module does not restate the pattern, texts that
    hold the string of an added token (such as ``<|endoftext|>``, which the library finds in texts whatever
    ``add_special_tokens`` says), and tokenizers of another build go through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        self.by_piece = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and made.get("normalizer") is None
            and made["model"].get("type") == "BPE"
            and not made["model"].get("ignore_merges")
            and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or re.search(r"\s", x["content"]) for x in made.get("added_tokens", []))
        )
        added = [x["content"] for x in made.get("added_tokens", [])]
        self.other = re.compile("|".join([_OTHER.pattern, *map(re.escape, added)]))
        #: Bytes of text that each token stands for, where tokens are runs of bytes.
        self.bytes_of = np.zeros(0, np.int64)
        if self.by_piece:
            names = (self.tok.id_to_token(i) or "" for i in range(max(self.tok.get_vocab(with_added_tokens=True).values()) + 1))
            self.bytes_of = np.array([len(n.encode()) if n in added else len(n) for n in names], dtype=np.int64)
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self._clear()

    def _clear(self) -> None:
        self.numbers, self.chars, self.met = _Numbers(), 0, _Rows(np.int64)
        self.flat, self.first, self.n_ids = _Rows(self.dtype), _Rows(np.int64), _Rows(np.int64)

    def _forget(self) -> None:
        """Forget pieces met once, and the rarest beyond half of what is remembered."""
        met = self.met.data[: self.met.n]
        stay = np.argsort(-met, kind="stable")[: PIECES // 2]
        stay = np.sort(stay[met[stay] > 1])
        names, ids, n = list(self.numbers), self.ids_of(stay), self.n_ids.data[stay]
        chars = np.cumsum([len(names[i]) for i in stay.tolist()])
        stay, n = stay[: (k := int(np.searchsorted(chars, PIECE_CHARS // 2)))], n[:k]
        self._clear()
        for i in stay.tolist():
            self.numbers[names[i]] = len(self.numbers)
        self.chars = int(chars[k - 1]) if k else 0
        self.flat.add(ids[: int(n.sum())])
        self.first.add(np.cumsum(n) - n)
        self.n_ids.add(n)
        self.met.add(np.ones(k, np.int64))

    def pieces(self, texts: list[str]) -> tuple[list[list[str] | None], list[np.ndarray]]:
        """The pieces of each text (None: goes through the library whole) and their numbers."""
        if len(self.numbers) > PIECES or self.chars > PIECE_CHARS:
            self._forget()
        split = [_SPLIT.findall(t) if self.by_piece and not self.other.search(t) else None for t in texts]
        number = self.numbers.__getitem__
        at = [np.fromiter(map(number, p), np.int64, len(p)) if p else np.zeros(0, np.int64) for p in split]
        if new := self.numbers.new:
            got = self.tok.encode(new, is_pretokenized=True, add_special_tokens=False)
            to = np.searchsorted(np.array(got.word_ids, dtype=np.int64), np.arange(len(new) + 1))
            self.first.add(to[:-1] + self.flat.n)
            self.n_ids.add(np.diff(to))
            self.flat.add(np.array(got.ids, dtype=self.dtype))
            self.met.add(np.zeros(len(new), np.int64))
            self.chars += sum(map(len, new))
            self.numbers.new = []
        if at:
            self.met.data[: self.met.n] += np.bincount(np.concatenate(at), minlength=self.met.n)
        return split, at

    def ids_of(self, at: np.ndarray) -> np.ndarray:
        """The ids of pieces, end to end."""
        n = self.n_ids.data[at]
        to = np.cumsum(n)
        if not len(to):
            return np.zeros(0, self.dtype)
        return self.flat.data[np.arange(to[-1]) + np.repeat(self.first.data[at] - to + n, n)]

    def whole(self, text: str):
        return self.tok.encode(text, add_special_tokens=False)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, ``self.dtype`` wide."""
        out = []
        for part in bounded(texts):
            chunks = [list(cut(t)) if self.by_piece else [t] for t in texts[part]]
            for own in chunks:
                if len(own) > 1:
                    out.append(b"".join(self._encode([c])[0] for c in own))
                else:
                    out.append(None)
            short = iter(self._encode([own[0] for own in chunks if len(own) == 1]))
            for i in range(len(out) - len(chunks), len(out)):
                if out[i] is None:
                    out[i] = next(short)
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        split, at = self.pieces(texts)
        every = np.concatenate(at) if at else np.zeros(0, np.int64)
        ids = self.ids_of(every).tobytes()
        n = np.cumsum(self.n_ids.data[every]) * self.dtype.itemsize
        upto = np.cumsum([len(x) for x in at])
        out, before = [], 0
        for t, p, k in zip(texts, split, upto.tolist()):
            to = int(n[k - 1]) if k else 0
            out.append(np.array(self.whole(t).ids, dtype=self.dtype).tobytes() if p is None else ids[before:to])
            before = to
        return out


def cut(text: str, chars: int = 1_000_000):
    """A long text in runs of about so many characters, cut where byte-level BPE splits in any case.

    That is before a single space between two characters that are no white space: no piece holds such
    a space but as its first character. A text without such places stays one run.
    """
    at = 0
    while len(text) - at > chars:
        m = _CUT.search(text, at + chars)
        if not m:
            break
        yield text[at : m.start() + 1]
        at = m.start() + 1
    yield text[at:]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder for each file and worker process."""
    return TextEncoder(path)


def bounded(texts: list[str], chars: int = 500_000):
    """Slices of ``texts`` of about so many characters, so that what is held at once has a bound: a piece of five
    characters is a string of some 60 bytes."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= chars:
            yield slice(at, i + 1)
            at, n = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))
