"""Cutting long texts at natural boundaries.

A text over the limit becomes pieces of at most `limit` tokens; each piece starts `overlap` tokens before
the end of the one before it. Dynamic programming over the boundaries chooses the ends: it minimises the
penalties of the cuts (PENALTY by kind of boundary, MID_WORD where an overlap starts inside a word), the
squared deviation of the pieces' sizes from an even division, and PIECE for each piece. All numbers of
pieces that can cost least are tried: what each number costs without regard to sizes is found first, for all
numbers at once. Boundaries of words and tokens are only tried where sections, claims, paragraphs and sentences
leave no solution, and then within NEAR tokens of an even division into the fewest pieces, or up to two more.

Sizes are tokens of the encoding of the whole text. Pieces start and end between characters; where no
such place has another one exactly `overlap` tokens before it, the overlap is up to the character before that. A piece that
starts or ends inside a word is kept SPARE tokens shorter, as its edge may be encoded differently by itself.
Null, empty and short texts give no rows; repeated rows are cut each. Extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.bpe import VOCABULARY, Encoder, encoded_batches

LIMIT, OVERLAP = 1024, 64
KINDS = ("section", "claim", "paragraph", "sentence", "word", "sign", "token", "end")
PENALTY = np.array([0.0, 0.2, 0.4, 1.0, 4.0, 8.0, 16.0, 0.0])
SECTION, CLAIM, PARAGRAPH, SENTENCE, WORD, SIGN, TOKEN, END = range(8)
MID_WORD = 0.5
PIECE = 1.0
EVEN = 1.0
SPARE = 4
NEAR = 48  # tokens on either side of an even division at which boundaries within sentences are tried
_CLAIM = re.compile(r"(?:claim|anspruch|revendication)\s*\d+\s*[:.)]|\d{1,3}\s*[.)]\s|[【\[]?(?:請求項|claim)\s*[\d０-９]+\s*[】\]]", re.IGNORECASE)
_HEADING = re.compile(r"(?:[\[【][^\]】\d]{2,60}[\]】]|[^\W\d_][^\n.!?;:,。！？]{1,58})\s*$")
_ENDS = [ord(c) for c in ".!?。！？…"]
_WIDE_ENDS = [ord(c) for c in "。！？"]


@cache
def _token_facts(path: str) -> tuple[np.ndarray, np.ndarray]:
    """For each token, whether it starts a character, and how many characters start in it."""
    import json

    from ostinato.llm.bpe import _byte_signs

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    of_sign = {s: b for b, s in enumerate(_byte_signs())}
    begins, chars = np.ones(max(vocab.values()) + 1, dtype=bool), np.zeros(max(vocab.values()) + 1, dtype=np.int64)
    for token, i in vocab.items():
        inner = [128 <= of_sign.get(c, 0) < 192 for c in token]
        begins[i], chars[i] = not (inner and inner[0]), len(inner) - sum(inner)
    return begins, chars


def _one_of(x: np.ndarray, values: list[int]) -> np.ndarray:
    out = x == values[0]
    for v in values[1:]:
        out |= x == v
    return out


def boundary_kinds(cp: np.ndarray, start: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """Kind of the boundary before each word; cp: the text, blank: which code points are white space."""
    n = len(cp)
    at = np.arange(n)
    lead = start + ((cp[start] == 32) & (start + 1 < n))  # first sign of the word
    last = np.maximum.accumulate(np.where(blank, -1, at))
    before = np.where(start > 0, last[np.maximum(start - 1, 0)], -1)  # last sign before the word
    breaks = np.concatenate([[0], np.cumsum(cp == 10)])
    lines = breaks[lead] - breaks[before + 1]
    empty = blank[np.minimum(lead, n - 1)]  # nothing but white space
    kind = np.where(cp[start] == 32, WORD, SIGN)
    left, sign = cp[np.maximum(before, 0)], cp[lead]
    ended = _one_of(left, _ENDS) & (before >= 0)
    wide = _one_of(left, _WIDE_ENDS) & (before >= 0)
    small = ((sign >= 97) & (sign <= 122)) | ((sign >= 48) & (sign <= 57)) | _one_of(sign, _ENDS)
    kind = np.where(((ended & (lead > before + 1)) | wide) & ~small, SENTENCE, kind)
    kind = np.where(lines > 0, PARAGRAPH, kind)
    kind = np.where(empty, SIGN, kind)
    for i in np.flatnonzero(kind == PARAGRAPH).tolist():
        head = cp[lead[i] : lead[i] + 80].tobytes().decode("utf-32-le").split("\n", 1)
        if _CLAIM.match(head[0]):
            kind[i] = CLAIM
        elif len(head) > 1 and lines[i] > 1 and _HEADING.match(head[0]):
            kind[i] = SECTION
    return kind


def best_ends(n: int, places: np.ndarray, cost: np.ndarray, mid: np.ndarray, rough: np.ndarray, limit: int, overlap: int, pieces: int) -> tuple[float, np.ndarray] | None:
    """Ends of `pieces` pieces of n tokens at the least cost; places: where cuts may be, ascending; None if there's no way.

    mid: the next piece starts inside a word; rough: this piece ends inside a word.
    """
    step = limit - overlap
    even = (n + overlap * (pieces - 1)) / pieces
    at, total = np.array([overlap]), np.zeros(1)  # the first piece starts at 0
    spare = np.zeros(1, dtype=np.int64)
    back: list[np.ndarray] = []
    stops: list[np.ndarray] = []
    for i in range(1, pieces + 1):
        if i == pieces:
            q, own, cut_short, next_spare = np.array([n]), np.zeros(1), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        else:
            lo, hi = np.searchsorted(places, [max(n - step * (pieces - i), overlap + 1), min(limit + step * (i - 1), n - 1) + 1])
            q, own = places[lo:hi], cost[lo:hi]
            cut_short, next_spare = SPARE * rough[lo:hi].astype(np.int64), SPARE * mid[lo:hi].astype(np.int64)
        if not len(q):
            return None
        size = np.subtract.outer(q, at).astype(np.float64)  # without the overlap
        wrong = size > step
        if spare.any() or cut_short.any():
            wrong |= size + spare + cut_short[:, None] > step
        wrong |= np.less_equal.outer(q, at)
        size -= even - overlap
        size *= size
        size *= EVEN / even**2
        size += total
        size[wrong] = np.inf
        c = size
        choice = c.argmin(axis=1)
        new = c[np.arange(len(q)), choice] + own
        ok = np.isfinite(new)
        if not ok.any():
            return None
        back.append(choice[ok])
        stops.append(q[ok])
        at, total, spare = q[ok], new[ok], next_spare[ok]
    ends, j = [], 0
    for stop, come in zip(reversed(stops), reversed(back), strict=True):
        ends.append(stop[j])
        j = come[j]
    return float(total[0]) + PIECE * pieces, np.array(ends[::-1])


def fewest_pieces(n: int, places: np.ndarray, limit: int, overlap: int) -> int | None:
    """Least number of pieces with ends at `places` (ascending), each as far as it reaches; None if there's no way on."""
    at, count = 0, 1
    reach = limit
    while reach < n:
        i = int(np.searchsorted(places, reach, side="right")) - 1
        if i < 0 or places[i] <= max(at, overlap):
            return None
        at = int(places[i])
        reach = at - overlap + limit
        count += 1
    return count


def least_penalties(n: int, places: np.ndarray, cost: np.ndarray, limit: int, overlap: int, most: int) -> np.ndarray:
    """Least sum of the costs of the cuts for each number of pieces up to `most`, whatever their sizes; infinite where there's no way."""
    step = limit - overlap
    out = np.full(most + 1, np.inf)
    lo, hi = np.searchsorted(places, places - step), np.arange(len(places))
    window = np.stack([lo, np.maximum(hi, lo + 1)], axis=1).ravel()
    final = np.searchsorted(places, n - step)
    total = np.where(places <= limit, cost, np.inf)
    for pieces in range(2, most + 1):
        out[pieces] = total[final:].min(initial=np.inf)
        least = np.minimum.reduceat(np.append(total, np.inf), window)[::2]
        total = np.where(lo < hi, least, np.inf) + cost
    return out


def _full_pieces(n: int, starts_char: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last token of pieces as long as they may be, cut between characters wherever those are."""
    at = np.arange(n + 1)
    before = np.maximum.accumulate(np.where(starts_char, at, 0))  # the character that starts at or before each token
    first, ends = [0], []
    while first[-1] + limit < n:
        end = int(before[first[-1] + limit])
        ends.append(end)
        first.append(max(int(before[end - overlap]), first[-1] + 1))
    return np.array(first), np.array([*ends, n])


def cut_text(cp: np.ndarray, blank: np.ndarray, start: np.ndarray, counts: np.ndarray, tokens: np.ndarray, facts: tuple[np.ndarray, np.ndarray], limit: int, overlap: int, near: int = NEAR):
    """Pieces of one text: first and last token, first and last character, kind of the cut at the end.

    start: where its words start; counts: their tokens; tokens: all tokens of the text.
    """
    begins, chars = facts
    n = len(tokens)
    kind = boundary_kinds(cp, start, blank)
    word_at = np.cumsum(counts) - counts  # token each word starts at
    starts_char = np.append(begins[tokens], True)
    starts_word = np.zeros(n + 1, dtype=bool)
    starts_word[word_at], starts_word[n] = True, True
    kinds = np.full(n + 1, TOKEN)
    kinds[word_at[counts > 0]] = kind[counts > 0]
    at = np.arange(n + 1)
    can_end = starts_char & (at > overlap) & (at < n)
    can_end[overlap:] &= starts_char[: n + 1 - overlap]
    char_at = np.concatenate([[0], np.cumsum(chars[tokens])])
    least = max(2, -(-(n - overlap) // (limit - overlap)))
    natural = can_end & (kinds <= SENTENCE)
    best = None

    def cut(near: np.ndarray, pieces: int) -> None:
        nonlocal best
        places = np.flatnonzero(near)
        mid = ~starts_word[np.maximum(places - overlap, 0)]
        got = best_ends(n, places, PENALTY[kinds[places]] + MID_WORD * mid, mid, kinds[places] == TOKEN, limit, overlap, pieces)
        if got and (best is None or got[0] < best[0]):
            best = got

    places = np.flatnonzero(natural)
    fewest = fewest_pieces(n, places, limit, overlap)
    if fewest is not None:
        # With as much to spare as any cut takes there's always a way.
        pieces, last = fewest, fewest_pieces(n, places, limit - 2 * SPARE, overlap) or fewest + 2
        while best is None and pieces <= last:
            cut(natural, pieces)
            pieces += 1
        if best:
            cost = PENALTY[kinds[places]] + MID_WORD * ~starts_word[np.maximum(places - overlap, 0)]
            bound = least_penalties(n, places, cost, limit, overlap, int(best[0] / PIECE)) + PIECE * np.arange(int(best[0] / PIECE) + 1)
            bound[:pieces] = np.inf
            for other in np.argsort(bound, kind="stable").tolist():
                if bound[other] >= best[0]:
                    break
                cut(natural, other)
    for worst in (WORD, TOKEN):
        if best:
            break
        for pieces in range(least, least + 3):
            even = np.arange(1, pieces) * (n - overlap) / pieces + overlap
            around = np.unique(np.clip((even[:, None] + np.arange(-near, near + 1)).astype(np.int64), 0, n))
            tried = natural.copy()
            tried[around] |= (can_end & (kinds <= worst))[around]
            if best is None or best[0] > PIECE * pieces:
                cut(tried, pieces)
    if best is None:
        first, ends = _full_pieces(n, starts_char, limit, overlap)
    else:
        ends = best[1]
        first = np.concatenate([[0], ends[:-1] - overlap])
    kinds[n] = END
    return first, ends, char_at[first], char_at[ends], kinds[ends]


_PIECES = "key long, piece int, first_token int, last_token int, n_tokens int, first_char int, last_char int, cut string, text string"


def cut_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of the texts of more than `limit` tokens: key, piece (from 0), first_token, last_token (half-open), n_tokens, first_char, last_char, cut, text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = _token_facts(vocabulary)
        for e, batch, words in encoded_batches(batches, vocabulary, "text"):
            yield from _cut_batch(e, batch, words, facts, limit, overlap)

    narrow = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(cut, _PIECES).withColumnRenamed("key", key)


def _cut_batch(e: Encoder, batch: pa.RecordBatch, words, facts, limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    from ostinato.llm.bpe import SPACE, _classes, _ranges

    long = np.flatnonzero(e.counts(words) > limit)
    keys, texts = batch.column(0), batch.column(1)
    cols: dict[str, list] = {c.split(" ")[0]: [] for c in _PIECES.split(", ")}
    base = np.cumsum(np.concatenate([[0], pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False) + 1]))
    for i in long.tolist():
        lo, hi = words.first[i], words.first[i + 1]
        value = texts[i].as_py()
        cp = np.frombuffer(value.encode("utf-32-le"), dtype=np.uint32)
        code = words.code[lo:hi]
        counts = e.token_count(code)
        tokens = e.tokens[_ranges(e.token_at[code], counts)]
        first, last, a, b, kind = cut_text(cp, _classes()[cp] == SPACE, words.start[lo:hi] - base[i], counts, tokens, facts, limit, overlap)
        cols["key"].extend([keys[i].as_py()] * len(first))
        cols["piece"].extend(range(len(first)))
        for name, x in (("first_token", first), ("last_token", last), ("n_tokens", last - first), ("first_char", a), ("last_char", b)):
            cols[name].extend(x.tolist())
        cols["cut"].extend(KINDS[k] for k in kind)
        cols["text"].extend(value[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True))
    schema = pa.schema([(c, pa.int64() if c == "key" else pa.string() if c in ("cut", "text") else pa.int32()) for c in cols])
    yield pa.RecordBatch.from_pydict(cols, schema=schema)
