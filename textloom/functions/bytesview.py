"""Column functions on bytes, built from Catalyst expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.operators.codecs import LOG_MARKS, SHARDS, TIER_SLOTS

STOP_WORDS = sorted("and are but for from has have in is not of that the their they this to was with".split())
ROLE_SHARD = {"assistant": "assistant", "assistant_response": "assistant", "code_block": "code", "system": "system", "system_message": "system", "tool_call": "tool_call", "tool_result": "tool_result", "user": "user", "user_intent": "user"}


def byte_view(text: Column) -> Column:
    """A string with one character a byte of the UTF-8 text, so that string functions count bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def of_byte_view(view: Column) -> Column:
    return F.decode(F.encode(view, "ISO-8859-1"), "UTF-8")


def category(text: Column) -> Column:
    """log, json, mixed or text, from the first 256 bytes; a null text is null."""
    head = F.substring(byte_view(text), 1, 256)
    has = lambda *marks: F.expr("false") if not marks else _any(head.contains(m) for m in marks)
    opening = F.regexp_extract(head, r"^[\x00-\x20]*([\{\[])", 1)
    return (
        F.when(head.isNull(), None).when(has(*(m.decode() for m in LOG_MARKS)), "log").when(opening != "", "json")
        .when(has(":{", '":') & has(" the ", " and "), "mixed").otherwise("text")
    )


def _any(tests) -> Column:
    out = None
    for t in tests:
        out = t if out is None else out | t
    return out


def shard_of(role: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ROLE_SHARD.items() for x in pair))
    return F.coalesce(names[F.coalesce(role, F.lit(""))], F.lit("generic"))


def shard_code(shard: Column) -> Column:
    codes = F.create_map(*(x for name, code in SHARDS.items() for x in (F.lit(name), F.lit(code))))
    return F.coalesce(codes[shard], F.lit(0))


def escaped(view: Column) -> Column:
    return F.replace(view, F.lit("\x01"), F.lit("\x01\x00"))


def residual(view: Column) -> Column:
    """What is left of codon bytes without their two-byte tokens and escapes."""
    return F.regexp_replace(view, r"(?s)\x01.", "")


def words(text: Column) -> Column:
    """Lower-case ASCII words of three letters or more, stop words left out."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9']{2,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS))


def ratio(bytes_in: Column, bytes_out: Column) -> Column:
    """Input through output; 1 where there is no output."""
    return F.when(bytes_out == 0, 1.0).otherwise(bytes_in / bytes_out)


def alternation(patterns: list[str]) -> str:
    """A regular expression of the patterns, longest first, that means the same to Java and RE2."""
    quoted = lambda p: "".join(c if c.isalnum() or c in " _" else f"\\x{{{ord(c):x}}}" for c in p)
    return "|".join(quoted(p) for p in sorted(set(patterns), key=lambda p: (-len(p), p)))


def fnv1a(ids: Column) -> Column:
    """64-bit FNV-1a over the low bytes of an array of ids, as decimal digits.

    In two halves of 32 bits, as a product of 64 bits overflows: the prime is 2**40 + 0x1b3, so the low half's product
    carries into the high one, and the low half shifted by 40 bits reaches only the high one."""
    mask = F.lit(0xFFFFFFFF)

    def step(h: Column, i: Column) -> Column:
        low = h["low"].bitwiseXOR(F.pmod(i, F.lit(256)).cast("long"))
        product = low * 0x1B3
        high = h["high"] * 0x1B3 + F.shiftrightunsigned(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(mask).alias("high"), product.bitwiseAND(mask).alias("low"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))
    return F.aggregate(ids, start, step, lambda h: (h["high"].cast("decimal(20,0)") * (1 << 32) + h["low"]).cast("decimal(20,0)").cast("string"))


def tier_of_id(token_id: Column, slots: tuple[int, ...] = TIER_SLOTS) -> Column:
    """The tier of a token id from 1, when every tier but the last has all its slots."""
    out, upto = None, 0
    for tier, n in enumerate(slots[:-1]):
        upto += n
        out = F.when(token_id <= upto, tier) if out is None else out.when(token_id <= upto, tier)
    return out.otherwise(len(slots) - 1)


def key_prefix(key: Column, size: int = 12) -> Column:
    """What is shown of a key."""
    return F.substring(key, 1, size)


def varint_hex(value: Column) -> Column:
    """A non-negative long as a LEB128 varint in hexadecimal digits."""
    groups = F.filter(F.sequence(F.lit(0), F.lit(8)), lambda i: (i == 0) | (F.call_function("shiftright", value, (i * 7).cast("int")) > 0))
    digit = lambda i: F.call_function("shiftright", value, (i * 7).cast("int")).bitwiseAND(F.lit(127)) + F.when(F.call_function("shiftright", value, (i * 7 + 7).cast("int")) > 0, 128).otherwise(0)
    return F.array_join(F.transform(groups, lambda i: F.lpad(F.hex(digit(i)), 2, "0")), "")
