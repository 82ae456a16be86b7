"""Column functions over lines and texts; Unicode aware, with \\n as the only line end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space of any kind, as ``(?U)\\s`` has it.
SPACES = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(SPACES))


def is_prose(line: Column) -> Column:
    """A line that ends like a sentence, closing quotes and brackets aside."""
    end = F.rtrim(strip(line), F.lit("\"')]}"))
    return end.endswith(".") | end.endswith("!") | end.endswith("?") | end.endswith("…")


def symbol_density(line: Column) -> Column:
    """Share of characters other than letters among those that are not white space; 0 for blank lines."""
    n = F.length(F.regexp_replace(line, r"(?U)\s+", ""))
    return F.when(n == 0, 0.0).otherwise(1.0 - F.length(F.regexp_replace(line, r"[^\p{L}]+", "")) / n)


def header_signature(line: Column) -> Column:
    """A line with its numbers as # and all but a-z as spaces, so that reprinted headers agree."""
    numbered = F.regexp_replace(F.lower(strip(line)), r"(?U)\d+", "#")
    return F.trim(F.regexp_replace(numbered, "[^a-z#]+", " "))


def replace_characters(c: Column, table: dict[str, str]) -> Column:
    """Each character of ``table`` replaced by its text; a pass for each of them would take longer."""
    order = sorted(table)
    # plain letters, with accents or without, fail at small classes
    listed = f"(?=[{''.join(x for x in order if x < chr(127))}\\x7f-\\uffff])(?=[^À-ı])[{''.join(order)}]"
    if any("À" <= x <= "ı" for x in order):
        listed = listed.replace("(?=[^À-ı])", "")
    names, texts = F.array(*map(F.lit, order)), F.array(*[F.lit(table[x]) for x in order])
    return replace_found(c, listed, lambda x: F.get(texts, (F.array_position(names, x) - 1).cast("int")))


def replace_found(c: Column, pattern: str, how, found: Column | None = None) -> Column:
    """Each match of ``pattern`` replaced by what ``how`` makes of it; ``found`` are the matches, if they are known."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)) if found is None else found
    return F.array_join(F.zip_with(F.split(c, pattern, -1), found, lambda piece, x: F.concat(piece, F.coalesce(how(x), F.lit("")))), "")


_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def spell_below_thousand(n: Column) -> Column:
    """0 to 999 in words, without hyphens."""
    ones = F.array(*map(F.lit, _ONES))
    tens = F.array(*map(F.lit, _TENS))
    r = n % 100
    low = F.when(r < 20, F.get(ones, r)).when(r % 10 == 0, F.get(tens, F.floor(r / 10).cast("int") - 2)).otherwise(F.concat_ws(" ", F.get(tens, F.floor(r / 10).cast("int") - 2), F.get(ones, r % 10)))
    hundreds = F.concat(F.get(ones, F.floor(n / 100).cast("int")), F.lit(" hundred"))
    return F.when(n < 100, low).when(r == 0, hundreds).otherwise(F.concat_ws(" ", hundreds, low))


def spell_numbers(text: Column) -> Column:
    """Whole numbers up to 999 in words; longer ones stay."""
    pieces = F.split(text, r"(?U)(?<=\b)(?=\d+\b)|(?<=\d)(?!\d)(?=\b)", -1)

    def spelt(x: Column) -> Column:
        n = x.try_cast("bigint")
        return F.when(x.rlike(r"\A[0-9]{1,15}\z") & (n <= 999), spell_below_thousand(n.cast("int"))).otherwise(x)

    return F.array_join(F.transform(pieces, spelt), "")


def fixed(x: Column, digits: int) -> Column:
    """A double with so many digits after the point, rounded as its exact binary value demands, ties to even.

    The product with a power of ten is a tie or not as the exact one is, unless it is a tie by rounding: then the error of the product, worked out
    from halves of both factors, tells the side.
    """
    y = float(10**digits)

    def halves(v):
        big = v * 134217729.0
        high = big - (big - v)
        return high, v - high

    p = x * y
    (a, b), (c, d) = halves(x), halves(F.lit(y))
    error = ((a * c - p) + a * d + b * c) + b * d
    low = F.floor(p).cast("double")
    whole = F.when((p - low == 0.5) & (error > 0), low + 1).when((p - low == 0.5) & (error < 0), low).otherwise(F.rint(p))
    return F.format_string(f"%.{digits}f", whole / y)
