"""Byte-level BPE over Arrow batches with the tokenizers library.

A text is cut into chunks where a cut cannot change its tokens: between a character that is
no white space and a space. The splitting pattern of such vocabularies never joins the two,
and it looks at nothing to the left. Each distinct chunk of a batch is encoded once and kept in
a bounded memo of the worker, and the ids are gathered by index, so the library's work
follows the distinct words and not the text. Nothing about the result depends on the memo.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space as the vocabularies' pattern sees it (Unicode White_Space).
_WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_EDGE = re.compile(f"^(?:[{_WS}]|$)|[{_WS}]$")
# Bounds of the memo: longest text kept, most texts kept (about; one call's may be over).
_KEEP_CHARS, _KEEP = 48, 800_000
# Characters encoded at a time.
SLICE = 8_000_000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable bytes themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        pairs = map(bytes.split, lines)
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def tokenizer_from_ranks(ranks: dict[bytes, int]):
    """A tokenizers BPE that merges as rank files mean it.

    A rank file merges any neighbours whose union has a rank, lowest rank first, so every
    such pair becomes a merge, ordered by the rank of its result. Whole pieces that have a
    rank are taken as they are.
    """
    from tokenizers import Tokenizer, models, pre_tokenizers

    alphabet = byte_alphabet()
    name = {t: "".join(alphabet[b] for b in t) for t in ranks}
    merges = [
        (name[t[:cut]], name[t[cut:]])
        for t in sorted(ranks, key=ranks.get)
        for cut in range(len(t) - 1, 0, -1)
        if t[:cut] in ranks and t[cut:] in ranks
    ]
    vocab = {name[t]: rank for t, rank in ranks.items()}
    made = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return made


class Encoder:
    """Ids of texts, and bytes of ids, for one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        if path.endswith(".json"):
            self.library = Tokenizer.from_file(path)
        else:
            self.library = tokenizer_from_ranks(read_ranks(path))
        self.model = self.library.model
        alphabet = byte_alphabet()
        self._to_name = {b: c for b, c in enumerate(alphabet)}
        byte_of = {c: b for b, c in enumerate(alphabet)}
        vocab = self.library.get_vocab(with_added_tokens=True)
        whole = json.loads(self.library.to_str())
        plain = whole["model"]["vocab"]
        # Strings the library takes out of a text before it splits it.
        self._added = [t["content"] for t in whole.get("added_tokens") or []]
        self.token_bytes = [b""] * (max(vocab.values()) + 1)
        for token, at in vocab.items():
            self.token_bytes[at] = (
                bytes(byte_of[c] for c in token) if token in plain else token.encode()
            )
        self._byte_count = np.array([len(t) for t in self.token_bytes], np.int64)
        self._byte_start = np.cumsum(self._byte_count) - self._byte_count
        self._byte_pool = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        # Ids of chunks seen of late, and of those before: a chunk in use is never forgotten.
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        # texts of the memo whose white space goes with what stands beside them
        self._edged: set[str] = set()

    # Encoding

    def _piece(self, text: str) -> bytes:
        """Ids of one piece of the pattern."""
        if text.isascii() and text[1:].isalpha():
            name = "\u0120" + text[1:] if text[0] == " " else text
        else:
            name = text.encode().decode("latin-1").translate(self._to_name)
        return array("I", [t.id for t in self.model.tokenize(name)]).tobytes()

    def _encode_new(self, texts: list[str]) -> None:
        """Enter texts into the memo. Letters after an optional space are one piece."""
        hard = []
        for text in texts:
            word = text[1:] if text[:1] == " " else text
            if word.isalpha() and (word.isascii() or max(word) < "ɐ"):
                self._memo[text] = self._piece(text)
            elif word[-1:] in (".", ",") and word[:-1].isalpha() and max(word) < "ɐ":
                head = self._memo.get(text[:-1]) or self._piece(text[:-1])
                mark = self._memo.get(word[-1])
                if mark is None:
                    mark = self._memo[word[-1]] = self._piece(word[-1])
                self._memo[text] = head + mark
            else:
                hard.append(text)
                if text[:1] == " " and _EDGE.search(word):
                    self._edged.add(text)
        for text, made in zip(hard, self._library_ids(hard)):
            self._memo[text] = made

    def _library_ids(self, texts: list[str]) -> list[bytes]:
        made = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in made]

    def _ids_of(self, texts: list[str]) -> list[bytes]:
        """Ids of chunks, through the memo unless they are long."""
        if len(self._memo) > _KEEP // 2:
            self._older, self._memo = self._memo, {}
            self._edged.intersection_update(self._older)
        memo, older = self._memo, self._older
        found = list(map(memo.get, texts))
        missing = []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            ids = older.get(texts[i])
            if ids is None:
                missing.append(i)
            else:
                found[i] = memo[texts[i]] = ids
        if missing:
            short = [texts[i] for i in missing if len(texts[i]) <= _KEEP_CHARS]
            long = {t: None for t in (texts[i] for i in missing) if len(t) > _KEEP_CHARS}
            self._encode_new(list(dict.fromkeys(short)))
            long = dict(zip(long, self._library_ids(list(long))))
            for i in missing:
                found[i] = memo[texts[i]] if texts[i] in memo else long[texts[i]]
        return found

    def _whole(self, text: str) -> bytes:
        """Ids of a text with other white space than single spaces between words."""
        return b"".join(self._ids_of(_CHUNK.findall(text)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, number of ids of each text); null counts as empty."""
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(texts, " ")
        starts = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().copy()
        spaced = [" " + w for w in words]
        entries = self._ids_of(spaced)
        unsafe = np.fromiter(map(self._edged.__contains__, spaced), bool, len(spaced))
        for i in [i for i, w in enumerate(spaced) if len(w) > _KEEP_CHARS]:  # not in the memo
            unsafe[i] = _EDGE.search(words[i]) is not None
        if len(starts):
            firsts = [words[c] for c in codes[starts]]
            odd = np.logical_or.reduceat(unsafe[codes], starts)
            # A blank or empty text is odd as well: its only chunk is empty.
            special = np.zeros(len(odd), bool)
            for string in self._added:
                special |= pc.match_substring(texts, string).to_numpy(zero_copy_only=False)
            odd |= special
            own = [
                self._library_ids([texts[i].as_py()])[0]
                if special[i]
                else self._whole(texts[i].as_py())
                for i in np.flatnonzero(odd)
            ]
            none = len(entries)
            entries.append(b"")
            ends = np.append(starts[1:], len(codes))
            for i in np.flatnonzero(odd):
                codes[starts[i] : ends[i]] = none
            codes[starts[odd]] = none + 1 + np.arange(len(own))
            entries += own
            plain = np.flatnonzero(~odd)
            codes[starts[plain]] = len(entries) + np.arange(len(plain))
            entries += self._ids_of([firsts[i] for i in plain])
        pool = np.frombuffer(b"".join(entries), np.uint32)
        sizes = np.array([len(e) // 4 for e in entries], np.int64)
        ids, counts = gather(pool, np.cumsum(sizes) - sizes, sizes, codes)
        if not len(starts):
            return ids, np.zeros(0, np.int64)
        return ids, np.add.reduceat(counts, starts)

    # Decoding

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all bytes in order, number of bytes of each id)."""
        return gather(self._byte_pool, self._byte_start, self._byte_count, ids)


def gather(pool, starts, sizes, codes) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``pool`` one after the other, as ``codes`` name them; and their lengths."""
    counts = sizes[codes]
    total = int(counts.sum())
    shift = starts[codes] - (np.cumsum(counts) - counts)
    return pool[np.repeat(shift, counts) + np.arange(total)], counts


def character_offsets(data: bytes, byte_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end, in code points, of consecutive runs of bytes.

    A character split over several tokens belongs to each of them: a token starts at the
    character of its first byte and ends behind the character of its last.
    """
    raw = np.frombuffer(data, np.uint8)
    lead = (raw & 0xC0) != 0x80
    number = np.cumsum(lead) - 1  # character each byte belongs to
    ends = np.cumsum(byte_counts)
    starts = ends - byte_counts
    return number[starts], number[ends - 1] + 1


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(path)


def slices(texts: pa.Array, limit: int = SLICE):
    """Ranges of a batch with about ``limit`` bytes of text each, one text at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield at, i
            at, total = i, 0
        total += int(n)
    if at < len(sizes):
        yield at, len(sizes)
