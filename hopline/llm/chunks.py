"""Texts of an Arrow batch cut into chunks at spaces, each distinct chunk once, and those into pre-tokens, each distinct one once.

A byte-level pre-tokenizer always begins a new pre-token at a space between two characters of which the second is not white space, if the first is not
either or ends a run of white space. So the tokens of a text are those of its chunks in a row: the head, and each further piece with the space before it.
Texts where that does not hold (a space that follows white space and is followed by white space or the end; special strings; code points whose class may
differ between Unicode versions) are left to the tokenizer whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut at a time.
BATCH_BYTES = 12 << 20

_SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_RUN = rf"{_SPACE} (?:{_SPACE}|\z)"
# Blocks of code points whose letter, digit and space classes were stable before any Unicode version in use; all others count as unknown.
_UNKNOWN = r"[^\t-\r\x20-\x{84}\x{86}-\x{4ff}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20bf}\x{2190}-\x{22ff}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}]"


#: Pieces that may be joined by spaces again without new runs of white space.
_ROUGH = rf"^\z|^{_SPACE}|{_SPACE}\z"


@dataclass
class Cut:
    """A part of a batch. Its plain rows are, in order, the tokens ``tokens[index]``, of which row k has those from ``bounds[k]`` to ``bounds[k + 1]``."""

    first: int  # row of the batch at which the part begins
    texts: pa.Array
    whole: np.ndarray  # rows of the part that the tokenizer must see whole
    plain: np.ndarray  # the others
    tokens: list[str]  # distinct pre-tokens
    index: np.ndarray
    bounds: np.ndarray


def _parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(lengths) - lengths) // BATCH_BYTES
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(lengths)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield a, texts.slice(a, b - a)


def gather(sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of given sizes that lie end to end: the places of the runs ``index`` in a row, and where each of them ends."""
    n = sizes[index]
    ends = np.cumsum(n)
    shift = ((np.cumsum(sizes) - sizes)[index] - (ends - n)).astype(np.int32)  # a part has fewer places than that
    places = np.repeat(shift, n)
    places += np.arange(len(places), dtype=np.int32)
    return places, ends


def cut(texts: pa.Array, special: list[str], find: Callable[[str], list[str]]) -> Iterator[Cut]:
    """Parts of a batch of non-null texts, in order; ``find`` gives the pre-tokens of a string."""
    for first, part in _parts(texts):
        odd = pc.or_(pc.match_substring_regex(part, _RUN), pc.match_substring_regex(part, _UNKNOWN))
        for s in special:
            odd = pc.or_(odd, pc.match_substring(part, s))
        odd = odd.to_numpy(zero_copy_only=False).astype(bool)
        plain = part.filter(pa.array(~odd))
        split = pc.split_pattern(plain, " ")
        ends = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py() if len(plain) else np.zeros(1, np.int64)
        flat = split.flatten()
        is_head = np.zeros(len(flat), bool)
        is_head[ends[:-1]] = True
        coded = flat.filter(pa.array(~is_head)).dictionary_encode()
        pieces = coded.dictionary
        # units, in this order: smooth pieces, rough pieces, heads; the tokens of all units in a row
        rough = pc.match_substring_regex(pieces, _ROUGH).to_numpy(zero_copy_only=False).astype(bool)
        smooth_tokens = find(" " + " ".join(pieces.filter(pa.array(~rough)).to_pylist())) if (~rough).any() else []
        alone = [find(" " + p) for p in pieces.filter(pa.array(rough)).to_pylist()] + [find(h) for h in flat.filter(pa.array(is_head)).to_pylist()]
        named = pa.array(smooth_tokens + [t for tokens in alone for t in tokens], pa.string()).dictionary_encode()
        begins = pc.starts_with(named.dictionary, " ").to_numpy(zero_copy_only=False).astype(bool)[named.indices.to_numpy()[: len(smooth_tokens)]]
        smooth_sizes = np.diff(np.concatenate([np.flatnonzero(begins), [len(smooth_tokens)]])) if len(begins) else np.zeros(0, np.int64)
        sizes = np.concatenate([smooth_sizes, np.fromiter(map(len, alone), np.int64, len(alone))])
        unit = np.empty(len(pieces), np.int64)
        unit[np.flatnonzero(~rough)] = np.arange((~rough).sum())
        unit[np.flatnonzero(rough)] = (~rough).sum() + np.arange(rough.sum())
        order = np.empty(len(flat), np.int64)
        order[~is_head] = unit[coded.indices.to_numpy(zero_copy_only=False)]
        order[is_head] = len(pieces) + np.arange(len(plain))
        places, upto = gather(sizes, order)
        bounds = np.concatenate([[0], upto])[ends]
        yield Cut(first, part, np.flatnonzero(odd), np.flatnonzero(~odd), named.dictionary.to_pylist(), named.indices.to_numpy()[places], bounds)
