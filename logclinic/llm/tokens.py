"""Byte-level BPE over blocks of texts: every distinct unit is encoded once per block.

A unit is the text from one space that follows a non-space to the next.  The pre-token pattern always starts a pre-token
at such a space, so encoding units one by one gives the ids of the whole text.
"""

from __future__ import annotations

import os
import re
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from logclinic.llm.blocks import ranges

#: White space or a control before a space: such texts are cut by the exact pattern below instead of at every space.
SPACED = r"[\pZ\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}] "
CUT = re.compile(r"(?<=\S)(?= )")

#: The pre-token pattern of byte-level BPE (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Units that can be joined with others like them, and characters whose class is the same in all Unicode versions.
JOINT = r"^ (?s:.*)[^\pZ\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}]$"
COMMON = r"^[\x{0000}-\x{024F}]*$"
#: Units that are one pre-token.
LETTERS = r"^ ?[\p{L}]+$"

#: Longer units go to the tokenizer one by one.
LONG_UNIT = 1000

#: Distinct strings whose counts a worker keeps (about 100 bytes each); beyond it the table starts anew.
KNOWN_COUNTS = 1_000_000


def tokenizer_of(path: str) -> BlockTokenizer:
    """The tokenizer of this file, kept for the life of the Python worker."""
    kept = sys.modules.setdefault("_kept_tokenizers", types.ModuleType("_kept_tokenizers")).__dict__
    if path not in kept:
        kept[path] = BlockTokenizer(path)
    return kept[path]


def byte_letters() -> dict[str, int]:
    """The letter that byte-level BPE writes for each byte: printable bytes as they are, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class BlockTokenizer:
    """`path`: a tokenizers JSON file with byte-level BPE, without normalizer and without added prefix space."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's to share out
        self.known_counts: dict[str, int] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pattern = regex.compile(PRE_TOKEN)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        of_letter = byte_letters()
        vocabulary = {bytes(of_letter[c] for c in piece): i for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if all(c in of_letter for c in piece) and piece not in self.special}
        self.id_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, i in vocabulary.items():
            self.id_bytes[i] = len(piece)
        self.ranked = tiktoken.Encoding("ranked", pat_str=PRE_TOKEN, mergeable_ranks=vocabulary, special_tokens={})

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Codes of the units of all texts, the number of units of each text, and the distinct units by code."""
        if len(texts) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, SPACED)
        parts = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        encoded = parts.flatten().dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        plain = encoded.dictionary
        # code c: the part after a space; from len(plain) on: a part at the start of a text, which has no space
        heads = np.cumsum(counts) - counts
        firsts, inverse = np.unique(codes[heads], return_inverse=True)
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), plain, pa.scalar(" ", pa.large_string()))
        codes[heads] = len(plain) + inverse
        distinct = [spaced, plain.take(pa.array(firsts))]
        if pc.any(odd).as_py():
            codes, counts, more = self._with_odd(texts, odd.to_pylist(), codes, counts, len(plain) + len(firsts))
            distinct.append(more)
        return codes, counts, pa.concat_arrays(distinct)

    def _with_odd(self, texts, odd, codes, counts, known_so_far):
        """The odd texts cut by pattern, in their places."""
        known: dict[str, int] = {}
        heads, pieces, lengths = np.cumsum(counts) - counts, [], counts.copy()
        for row, is_odd in enumerate(odd):
            if is_odd:
                own = CUT.split(texts[row].as_py())
                pieces.append(np.fromiter((known.setdefault(x, known_so_far + len(known)) for x in own), np.int64, len(own)))
                lengths[row] = len(own)
            else:
                pieces.append(codes[heads[row] : heads[row] + counts[row]])
        return np.concatenate(pieces), lengths, pa.array(list(known), pa.large_string())

    def _has_special(self, distinct: pa.Array) -> np.ndarray:
        found = np.zeros(len(distinct), bool)
        for special in self.special:
            found |= pc.match_substring(distinct, special).to_numpy(zero_copy_only=False)
        return found

    def ids(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all distinct units one after the other, and the number of ids of each.

        Units that start with a space and end without one are encoded as one joined text with the same merges as ranks,
        and cut again by the tokens' byte lengths; the others go to the tokenizer itself.
        """
        lengths = pc.binary_length(distinct).to_numpy(zero_copy_only=False)
        joint = pc.match_substring_regex(distinct, JOINT).to_numpy(zero_copy_only=False) & (lengths <= LONG_UNIT) & ~self._has_special(distinct)
        kept = distinct.filter(pa.array(joint))
        flat_joint = np.zeros(0, np.uint32)
        borders = np.zeros(1, np.int64)
        if len(kept):
            joined = kept.buffers()[2].to_pybytes()[: int(lengths[joint].sum())].decode()
            flat_joint = np.array(self.ranked.encode_ordinary(joined), np.uint32)
            borders = np.concatenate([borders, np.searchsorted(np.cumsum(self.id_bytes[flat_joint]), np.cumsum(lengths[joint]), "left") + 1])
        counts = np.zeros(len(distinct), np.int64)
        counts[joint] = np.diff(borders)
        rest = np.flatnonzero(~joint)
        own = [x.ids for x in self.tokenizer.encode_batch_fast(distinct.take(pa.array(rest)).to_pylist(), add_special_tokens=False)]
        counts[rest] = [len(x) for x in own]
        flat = np.zeros(int(counts.sum()), np.uint32)
        heads = np.cumsum(counts) - counts
        flat[ranges(heads[joint], counts[joint])] = flat_joint
        if len(rest):
            flat[ranges(heads[rest], counts[rest])] = np.concatenate([np.array(x, np.uint32) for x in own])
        return flat, counts

    def pre_tokens(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Codes of the pre-tokens of all units, the number of each unit's, and the distinct pre-tokens by code.

        Units with special strings, or letters whose class depends on the Unicode version, stay whole: the tokenizer
        cuts them itself.
        """
        simple = pc.match_substring_regex(distinct, COMMON).to_numpy(zero_copy_only=False) & ~self._has_special(distinct)
        single = pc.match_substring_regex(distinct, LETTERS).to_numpy(zero_copy_only=False) | ~simple  # one pre-token
        counts = np.ones(len(distinct), np.int64)
        found: list[str] = []
        cut = np.flatnonzero(~single)
        for k, unit in zip(cut.tolist(), distinct.take(pa.array(cut)).to_pylist(), strict=True):
            own = self.pattern.findall(unit)
            counts[k] = len(own)
            found += own
        encoded = pa.chunked_array([distinct.filter(pa.array(single)), pa.array(found, pa.large_string())]).combine_chunks().dictionary_encode()
        given = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.zeros(int(counts.sum()), np.int64)
        heads = np.cumsum(counts) - counts
        codes[heads[single]] = given[: int(single.sum())]
        codes[ranges(heads[cut], counts[cut])] = given[int(single.sum()) :]
        return codes, counts, encoded.dictionary

    def counts(self, distinct: pa.Array) -> np.ndarray:
        """The number of pieces of each string, without its ids; counts once found are kept, in bounded memory.

        Pre-tokens (units cut by `pre_tokens`) of common characters are merged by rank; the rest goes to the tokenizer.
        """
        texts = distinct.to_pylist()
        known, get = self.known_counts, self.known_counts.get
        missing = np.flatnonzero(np.fromiter((get(x) is None for x in texts), bool, len(texts)))
        if len(missing):
            if len(known) + len(missing) > KNOWN_COUNTS:
                known.clear()
                missing = np.arange(len(texts))
            rows = distinct.take(pa.array(missing))
            simple = pc.match_substring_regex(rows, COMMON).to_numpy(zero_copy_only=False) & ~self._has_special(rows)
            encode = self.ranked.encode_ordinary
            own = rows.to_pylist()
            for text, is_simple in zip(own, simple.tolist(), strict=True):
                if is_simple:
                    known[text] = len(encode(text))
            for k in np.flatnonzero(~simple).tolist():
                known[own[k]] = len(self.tokenizer.encode(own[k], add_special_tokens=False))
        return np.fromiter(map(get, texts), np.int64, len(texts))


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of `values` over the consecutive runs of `counts`."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def gathered(flat: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The ids of the units named by `codes`, one after the other."""
    heads = np.cumsum(lengths) - lengths
    return flat[ranges(heads[codes], lengths[codes])]
