"""Byte-level BPE through the tokenizers library, one pre-token at a time, remembered per worker.

A byte-level BPE encodes each pre-token by itself, so a text's ids are its pre-tokens' ids in a row.
The special tokens' strings are cut out first, as the library's default does.

Pre-tokens are found here by `regex`, whose Unicode tables need not be the library's. So every encoder
first asks the library for the class (letter, number, white space, other) of every code point, and a
text that holds a code point on which the two differ goes through the library as a whole. So does
everything where the file's steps are not those of a plain byte-level BPE.

Pre-tokens that are not remembered are merged by tiktoken, which is faster than the library's model, where
the file lets both come to the same: the rank of every merge is the rank of what it makes, and the library
makes every token of the vocabulary out of its own bytes. Then two neighbours that tiktoken merges because
their union is a token are a pair that the library merges as well: without a merge across their ends the
bytes between these went the way they go alone, and that way ends in the token.
"""

from __future__ import annotations

import array
import json
import os
import re
from dataclasses import dataclass
from functools import lru_cache
from importlib import metadata

import regex

#: Pre-tokens that a worker remembers; the memory starts anew beyond that.
REMEMBERED = 300_000
#: Longest pre-token (in characters) that is remembered.
LONGEST = 64
#: Fixed value: the split pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[int, str]:
    """The letter of each byte: itself where it can be printed, else the next letter from 256 on."""
    shown = {b for b in range(256) if chr(b).isprintable() and b != 32}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


def _ranges(points: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


@lru_cache(2)
def _runs(end: int = 0x110000) -> dict[str, tuple[str, str]]:
    """By class of `regex`: a character of the class and all code points of it in a row, surrogates left out."""
    every = "".join(map(chr, [*range(min(end, 0xD800)), *range(0xE000, end)]))
    classes = {"letter": ("a", r"\p{L}"), "number": ("1", r"\p{N}"), "space": ("\t", r"\s"), "other": ("!", r"[^\s\p{L}\p{N}]")}
    return {k: (one, "".join(regex.findall(p + "+", every))) for k, (one, p) in classes.items()}


def differing(cut, end: int = 0x110000) -> list[tuple[int, int]]:
    """Ranges of code points below `end` whose class `regex` and the library see differently; cut: the library's pre-tokenizer.

    A row of characters of one class is one pre-token, so only where the library cuts such a row is there
    anything to look at.
    """
    odd: list[int] = []
    for one, row in _runs(end).values():
        for _, (a, b) in cut.pre_tokenize_str(row):
            if len(cut.pre_tokenize_str(one + row[a:b] + one)) > 1:
                odd += [ord(c) for c in row[a:b] if len(cut.pre_tokenize_str(one + c + one)) > 1]
    return _ranges(sorted(odd))


def plain_bpe(steps: dict) -> bool:
    """Whether a tokenizer's JSON is a byte-level BPE without any step that Encoder does not take itself."""
    cut, model = steps.get("pre_tokenizer") or {}, steps.get("model") or {}
    return (
        steps.get("normalizer") is None
        and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        and model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("byte_fallback")
        and not any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
        and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in steps.get("added_tokens", []))
    )


@dataclass(frozen=True)
class Traits:
    """What was found out about a file with these versions of the libraries: whether pre-tokens can be taken here, and
    whether tiktoken merges them alike."""

    easy: bool
    merges: bool
    versions: tuple[str, ...]


def versions() -> tuple[str, ...]:
    return tuple(metadata.version(n) for n in ("tokenizers", "regex", "tiktoken"))


def stamp(path: str) -> tuple[int, int]:
    """Tells a file from another that has taken its place."""
    s = os.stat(path)
    return s.st_mtime_ns, s.st_size


def traits(vocabulary: str) -> Traits:
    """Of a .json file; the driver sends them along, and a worker with other versions finds out itself."""
    return _traits(vocabulary, stamp(vocabulary))


@lru_cache(8)
def _traits(vocabulary: str, _: tuple[int, int]) -> Traits:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    steps = json.loads(tokenizer.to_str())
    easy = plain_bpe(steps) and not differing(tokenizer.pre_tokenizer, 0x100)
    return Traits(easy, easy and _merges_alike(tokenizer, steps), versions())


def _merges_alike(tokenizer, steps: dict) -> bool:
    model, letters = steps["model"], set(byte_letters().values())
    vocabulary, made = model["vocab"], -1
    for pair in model["merges"]:
        rank = vocabulary["".join(pair.split(" ") if isinstance(pair, str) else pair)]
        if rank <= made:
            return False
        made = rank
    special = {t["content"] for t in steps.get("added_tokens", [])}
    own = {t: i for t, i in vocabulary.items() if t not in special}
    if not letters <= own.keys() or not all(set(t) <= letters for t in own):
        return False
    return all([x.id for x in tokenizer.model.tokenize(t)] == [i] for t, i in own.items())


def merger(tokenizer):
    """A function from a pre-token's bytes to its ids by tiktoken, over the vocabulary of a file whose traits allow it."""
    import tiktoken

    back = {c: b for b, c in byte_letters().items()}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = {bytes(back[c] for c in t): i for t, i in tokenizer.get_vocab(with_added_tokens=True).items() if t not in special}
    return tiktoken.Encoding("of a file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Encoder:
    """ids(text) as little-endian unsigned 32-bit integers in bytes; `seen` maps pre-tokens to such bytes.

    vocabulary: a .json of tokenizers, or a .model of sentencepiece, which encodes whole texts itself.
    """

    def __init__(self, vocabulary: str, known: Traits | None = None):
        self.seen: dict[str, bytes] = {}
        if vocabulary.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
            self.library = lambda text: model.encode(text, num_threads=1)
            self.easy = False
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.library = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        if known is None or known.versions != versions():
            known = traits(vocabulary)
        self.easy = known.easy
        if not self.easy:
            return
        self.merge = merger(self.tokenizer) if known.merges else None
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = {s: self.pack([i]) for s, i in added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.split = regex.compile(PATTERN).findall
        self.letters, self.model = byte_letters(), self.tokenizer.model
        self._odd = False

    @property
    def odd(self):
        """A pattern of the code points on which the library differs, or None; found when a text first needs it."""
        if self._odd is False:
            odd = differing(self.tokenizer.pre_tokenizer)
            self._odd = re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in odd) + "]") if odd else None
        return self._odd

    def by_pieces(self, text: str) -> bool:
        """Whether the text's pre-tokens, as split() gives them, are the library's."""
        if not self.easy:
            return False
        try:
            text.encode("latin-1")  # of these code points the classes are the same
            return True
        except UnicodeEncodeError:
            return self.odd is None or self.odd.search(text) is None

    def parts(self, text: str) -> list[str]:
        """The text between special tokens, and these."""
        if self.cut is None or not any(s in text for s in self.special):
            return [text]
        return [p for p in self.cut.split(text) if p]

    def piece(self, piece: str) -> list[int]:
        """Ids of one pre-token: the library's model on its byte letters, or what comes to the same."""
        if self.merge is not None:
            return self.merge(piece.encode("utf-8", "surrogatepass"))
        letters = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(letters)]

    @staticmethod
    def pack(ids) -> bytes:
        return array.array("I", ids).tobytes()  # machines here are little-endian

    def learn(self, pieces) -> None:
        """Encodes all pieces not seen yet."""
        new = [p for p in set(pieces) if p not in self.seen]
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen = {}
            new = list(set(pieces))
        for p in new:
            self.seen[p] = self.pack(self.piece(p))

    def plain(self, text: str) -> bytes:
        pieces = self.split(text)
        try:
            return b"".join(map(self.seen.__getitem__, pieces))
        except KeyError:
            self.learn(pieces)
            return b"".join(map(self.seen.__getitem__, pieces))

    def ids(self, text: str) -> bytes:
        if not self.by_pieces(text):
            return self.pack(self.library(text))
        return b"".join(self.special.get(p) or self.plain(p) for p in self.parts(text))


_ENCODERS: dict[tuple, Encoder] = {}


def known(vocabulary: str) -> Traits | None:
    """For the driver to send to encoder()."""
    return traits(vocabulary) if vocabulary.endswith(".json") else None


def encoder(vocabulary: str, known: Traits | None = None) -> Encoder:
    """This worker's encoder of that file."""
    key = vocabulary, stamp(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary, known)
    return _ENCODERS[key]


def forget() -> None:
    """Drops this worker's encoders; the next task that needs one makes it anew."""
    _ENCODERS.clear()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
