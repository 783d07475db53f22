"""Pieces of SQL that several queries' statements share."""

# CRC-32 by its definition: a step of the register for each byte, eight shifts a step.
CRC_TABLE = """
crc_table as (select list(v order by i) as crc from (
    select i, list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from (select unnest(range(256)) as i)))
"""


def crc_sql(text: str) -> str:
    """SQL for a text's unsigned CRC-32; ``crc`` is the table of crc_table."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: cast('0x' || h as bigint))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::bigint], {codes}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])))"
