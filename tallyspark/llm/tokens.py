"""Token ids inside Python workers, with each distinct chunk of text encoded once.

The tokenizers used here cut a text wherever white space follows something else before they
merge anything, and between a word and the mark after it. So a text's ids are those of its
chunks (white space, then a word or other characters) one after another. A worker keeps the
ids of chunks it has seen in a dictionary of bounded size; the library encodes only the
others. ``Encoder`` checks the tokenizer's file for this
property and encodes whole texts where it isn't given.

A text that holds the string of a special token is encoded whole, as the library does by
default; with ``special_as_text`` such strings are ordinary text.
"""

import json
import os
import re
import unicodedata

import numpy as np

#: Unicode white space, stated whole: Python's ``\\s`` has four control characters more.
WHITE = r" \t\n\v\f\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Latin letters that stay letters in lower case, and ASCII marks that end a run of them in
#: every such tokenizer. The apostrophe isn't one, as it starts pieces of its own.
LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
STOPS = r"!\"#$%&()*+,./:;<=>?@\[\]^`{|}~-"
CACHED_CHUNKS = 800_000
LONGEST_CACHED = 64
#: Chunks encoded as one text; characters up to here keep their places in that.
JOINED = 2000
SIMPLE = "\u024f"

_encoders: dict = {}


class Encoder:
    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        special = [re.escape(t["content"]) for t in config["added_tokens"]]
        self.special = (None if special_as_text or not special
                        else re.compile("|".join(special)).search)
        pattern = _chunk_pattern(config)
        self.split = re.compile(pattern).findall if pattern else None
        self.known: dict[str, bytes] = {}
        if pattern:
            # In these vocabularies one character of an entry is one byte of text.
            end = config["model"]["end_of_word_suffix"] or ""
            vocab = config["model"]["vocab"]
            self.bytes_of = np.zeros(max(vocab.values()) + 1, "i8")
            for token, i in vocab.items():
                self.bytes_of[i] = len(token.removesuffix(end) if end else token)
            self.bare = bool(end)  # white space and case are dropped

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers; none for null."""
        if self.special and (marked := {t for t in texts if t and self.special(t)}):
            ids = {t: self._with_special(t) for t in marked}
            plain = iter(self.encode([t for t in texts if t not in marked]))
            return [ids[t] if t in marked else next(plain) for t in texts]
        if self.split is None:
            return [self._alone(t) if t else b"" for t in texts]
        parts = [self.split(t) if t else () for t in texts]
        wanted = set().union(*parts)
        missing = [c for c in wanted if c not in self.known]
        if len(self.known) + len(missing) > CACHED_CHUNKS:
            self.known.clear()
            missing = wanted
        long = {c: self._alone(c) for c in missing if len(c) > LONGEST_CACHED}
        self._learn([c for c in missing if c not in long])
        found = self.known | long if long else self.known
        return [b"".join(map(found.__getitem__, p)) for p in parts]

    def _with_special(self, text: str) -> bytes:
        self.tokenizer.encode_special_tokens = False
        try:
            return self._alone(text)
        finally:
            self.tokenizer.encode_special_tokens = True

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """Encode new chunks, many joined to a text; its ids are dealt out by their bytes."""
        if self.bare:
            joined = [c for c in chunks if c.isascii() or max(c) <= SIMPLE]
            glue = " "
        else:  # each starts with white space and ends with none, so that it stays a chunk
            joined = [c for c in chunks if c[0] in " \n" and c[-1] > " "
                      and (c.isascii() or max(c) <= SIMPLE)]
            glue = ""
        alone = list(set(chunks).difference(joined))
        groups = [joined[i:i + JOINED] for i in range(0, len(joined), JOINED)]
        encodings = self.tokenizer.encode_batch_fast([glue.join(g) for g in groups],
                                                     add_special_tokens=False)
        for group, encoding in zip(groups, encodings):
            ids = np.array(encoding.ids, "<u4")
            plain = (unicodedata.normalize("NFC", "\0".join(group)).lower().split("\0")
                     if self.bare else group)
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, plain)), "i8", len(plain)))
            reached = np.cumsum(self.bytes_of[ids])
            last = np.searchsorted(reached, ends)
            if last[-1] + 1 != len(ids) or (reached[last] != ends).any():
                alone += group  # a character's case or composition changed its length
                continue
            raw, stops = ids.tobytes(), (4 * (last + 1)).tolist()
            self.known.update(zip(group, map(raw.__getitem__, map(slice, [0, *stops], stops))))
        for c in alone:
            self.known[c] = self._alone(c)


def _chunk_pattern(config: dict) -> str | None:
    """What cuts a text into chunks for this tokenizer; None if chunks may not be used."""
    run = f"[{LETTERS}]++(?=[{WHITE}{STOPS}]|\\Z)"
    steps = config["pre_tokenizer"] or {}
    steps = steps.get("pretokenizers", [steps])
    normalizer = config["normalizer"] or {}
    kinds = [n["type"] for n in normalizer.get("normalizers", [normalizer] if normalizer else [])]
    if config["post_processor"] or any(
            t["lstrip"] or t["rstrip"] or t["single_word"] for t in config["added_tokens"]):
        return None
    if (not kinds and len(steps) == 1 and steps[0]["type"] == "ByteLevel"
            and steps[0]["use_regex"] and not steps[0]["add_prefix_space"]):
        return f"[{WHITE}]*(?:{run}|[^{WHITE}]+)|[{WHITE}]+"
    if (set(kinds) <= {"NFC", "Replace", "Lowercase"} and len(steps) == 2
            and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed"
            and steps[0]["invert"] and "[^\\s" in steps[0]["pattern"].get("Regex", "")
            and steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"]
            and not steps[1]["add_prefix_space"]):
        return f"{run}|[^{WHITE}]+"
    return None


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """This worker's encoder of a tokenizer file."""
    key = path, special_as_text
    if key not in _encoders:
        _encoders[key] = Encoder(path, special_as_text)
    return _encoders[key]
