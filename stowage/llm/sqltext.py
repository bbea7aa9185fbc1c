"""Pieces of DuckDB's SQL that several twins share."""

from __future__ import annotations


def sql_crc32(source: str, text: str) -> str:
    """All columns of ``source`` and ``crc``: the CRC-32 of a text, which DuckDB lacks.

    The bytes are folded with a table of remainders that the rule of the polynomial makes.
    """
    return f"""
    SELECT * EXCLUDE (bytes, remainders), xor(list_reduce(list_prepend(4294967295, bytes),
        lambda c, b: xor(c >> 8, remainders[(xor(c & 255, b) + 1)::INT])), 4294967295) AS crc
    FROM (SELECT *, list_transform(range(octet_length(encode({text}))),
            lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::BIGINT) AS bytes FROM {source}),
         (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
            lambda c, n: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS remainders)"""
