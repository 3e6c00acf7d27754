"""Pieces of SQL that several queries' SQL is made of."""

from __future__ import annotations

# The table of CRC-32, by its rule: eight steps of the reversed polynomial for each byte.
CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc_table)"""


def crc32_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of ``text``; ``crc_table`` must be in scope."""
    octets = f"list_transform(range(strlen({text})), lambda o: ('0x' || substr(hex(encode({text})), 2 * o + 1, 2))::BIGINT)"
    step = "xor(crc_table[1 + (xor(a, b) & 255)], a >> 8)"
    return f"xor(list_reduce({octets}, lambda a, b: {step}, 4294967295), 4294967295)"
