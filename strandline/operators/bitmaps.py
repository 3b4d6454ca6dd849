"""Sets of months as bits of whole numbers: windows are shifts, periods are runs of set bits.

A set is a list of columns, the words, of WORD bits each (the sign bit stays clear, so that no
step can overflow). Sets are built by OR in an aggregate that combines before its shuffle; what
is found from them needs no order of rows. Every step is a projection of plain arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 63
FULL = (1 << WORD) - 1
STEP = 32  # longest shift of a step


def _shift(function: str, word: Column, by: int | Column) -> Column:
    return F.call_function(function, word, F.lit(by).cast("int"))


def words_for(bits: int) -> int:
    return -(-bits // WORD)


def bit(place: Column, word: int) -> Column:
    """The word's value with the bit at ``place`` set, 0 if it lies in another word."""
    inside = F.floor(place / WORD) == word
    return F.when(inside, _shift("shiftleft", F.lit(1).cast("long"), place % WORD)).otherwise(F.lit(0).cast("long"))


def union_of(place: Column, words: int, only: Column | None = None) -> list[Column]:
    """Aggregates: the set of all ``place`` values of a group, of the rows where ``only`` is true."""
    bits = [bit(place, i) for i in range(words)]
    if only is not None:
        bits = [F.when(only, b).otherwise(F.lit(0).cast("long")) for b in bits]
    return [F.bit_or(b) for b in bits]


def lowered(words: Sequence[Column], by: int | Column) -> list[Column]:
    """Every place less ``by``; a column must stay under WORD."""
    words = [F.col(w) if isinstance(w, str) else w for w in words]
    skip, by = divmod(by, WORD) if isinstance(by, int) else (0, by)
    zero = F.lit(0).cast("long")
    at = lambda i: words[i] if i < len(words) else zero
    high = lambda w: _shift("shiftleft", w, F.lit(WORD) - by).bitwiseAND(F.lit(FULL))
    return [_shift("shiftright", at(i + skip), by).bitwiseOR(high(at(i + skip + 1))) if i + skip + 1 < len(words) else _shift("shiftright", at(i + skip), by) for i in range(len(words))]


def raised(words: Sequence[Column], by: int | Column) -> list[Column]:
    """Every place plus ``by`` (a column must stay under WORD); what leaves the last word is lost."""
    words = [F.col(w) if isinstance(w, str) else w for w in words]
    skip, by = divmod(by, WORD) if isinstance(by, int) else (0, by)
    zero = F.lit(0).cast("long")
    at = lambda i: words[i] if i >= 0 else zero
    low = lambda w: _shift("shiftleft", w, by).bitwiseAND(F.lit(FULL))
    return [low(at(i - skip)).bitwiseOR(_shift("shiftright", at(i - skip - 1), F.lit(WORD) - by)) if i - skip > 0 else low(at(i - skip)) for i in range(len(words))]


def either(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [x.bitwiseOR(y) for x, y in zip(a, b)]


def both(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [x.bitwiseAND(y) for x, y in zip(a, b)]


def below(words: Sequence[Column], n: int | Column) -> list[Column]:
    """Only the places under n."""
    out = []
    for i, w in enumerate(words):
        left = F.lit(n) - WORD * i
        mask = F.when(left >= WORD, F.lit(FULL)).when(left <= 0, F.lit(0).cast("long")).otherwise(_shift("shiftleft", F.lit(1).cast("long"), F.least(left, F.lit(WORD - 1))) - 1)
        out.append(w.bitwiseAND(mask))
    return out


def columns(prefix: str, words: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(words)]


def put(df: DataFrame, **sets: Sequence[Column]) -> DataFrame:
    """``df`` with each set's words as columns named by its prefix."""
    return df.withColumns({f"{prefix}{i}": w for prefix, words in sets.items() for i, w in enumerate(words)})


def get(prefix: str, words: int) -> list[Column]:
    return [F.col(c) for c in columns(prefix, words)]


def spread(df: DataFrame, prefix: str, words: int, reach: int | Column, most: int, up: bool) -> DataFrame:
    """The set and all places up to ``reach`` (at most ``most``) above each, or below each.

    A set that holds the next h places of each is shifted by up to h + 1 at once.
    """
    h = 0
    while h < most:
        step = min(h + 1, STEP)
        by = min(step, most - h) if isinstance(reach, int) else F.greatest(F.least(reach - h, F.lit(step)), F.lit(0))
        own = get(prefix, words)
        df = put(df, **{prefix: either(own, (raised if up else lowered)(own, by))})
        h += step
    return df


def twice_within(df: DataFrame, prefix: str, twice: str, words: int, length: int | Column, most: int) -> DataFrame:
    """``prefix`` becomes the places k with a member in k .. k + length - 1, ``twice`` those with two.

    ``twice`` holds the places that count double on their own. Lengths double, and those of the
    binary form of ``length`` are put one before the other, so that no place counts twice.
    """
    zero = [F.lit(0).cast("long")] * words
    df = put(df, **{f"{prefix}_all_": zero, f"{twice}_all_": zero})
    size = 1
    while size <= most:
        one, two, all_one, all_two = (get(p, words) for p in (prefix, twice, f"{prefix}_all_", f"{twice}_all_"))
        if not isinstance(length, int) or length & size:
            later_one, later_two = lowered(all_one, size), lowered(all_two, size)
            new_one, new_two = either(one, later_one), either(either(two, later_two), both(one, later_one))
            if not isinstance(length, int):
                used = length.bitwiseAND(F.lit(size)) != 0
                new_one, new_two = ([F.when(used, n).otherwise(o) for n, o in zip(new, old)] for new, old in ((new_one, all_one), (new_two, all_two)))
            df = put(df, **{f"{prefix}_all_": new_one, f"{twice}_all_": new_two})
        later_one, later_two = lowered(one, size), lowered(two, size)
        df = put(df, **{prefix: either(one, later_one), twice: either(either(two, later_two), both(one, later_one))})
        size *= 2
    return put(df, **{prefix: get(f"{prefix}_all_", words), twice: get(f"{twice}_all_", words)}).drop(*columns(f"{prefix}_all_", words), *columns(f"{twice}_all_", words))


def _lowest(x: Column) -> Column:
    """Place of the lowest set bit: what x & (x - 1) lacks, less one, has a bit for each place below it."""
    return F.bit_count(x.bitwiseXOR(x.bitwiseAND(x - 1)) - 1)


def lowest(words: Sequence[Column]) -> Column:
    """The least place of a set, null if it is empty."""
    return F.coalesce(*[F.when(w != 0, (_lowest(w) + i * WORD).cast("int")) for i, w in enumerate(words)])


def places(words: Sequence[Column]) -> Column:
    """The places of a set in order, as an array; work for the set bits only."""
    def of_word(w: Column, i: Column) -> Column:
        start = F.struct(w.alias("x"), F.array().cast("array<int>").alias("found"))
        step = lambda s, _: F.struct(s["x"].bitwiseAND(s["x"] - 1).alias("x"), F.array_append(s["found"], (i * WORD + _lowest(s["x"])).cast("int")).alias("found"))
        return F.aggregate(F.array_repeat(w, F.bit_count(w).cast("int")), start, step, lambda s: s["found"])

    return F.flatten(F.transform(F.array(*words), of_word))


def runs(words: Sequence[Column]) -> Column:
    """The runs of consecutive places as an array of (first, last)."""
    first = [w.bitwiseAND(F.bitwise_not(x)) for w, x in zip(words, raised(words, 1))]
    last = [w.bitwiseAND(F.bitwise_not(x)) for w, x in zip(words, lowered(words, 1))]
    run = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    # Most sets are one run, which needs no array of places.
    n = sum((F.bit_count(w) for w in first), F.lit(0))
    return F.when(n == 1, F.array(run(lowest(first), lowest(last)))).otherwise(F.zip_with(places(first), places(last), run))
