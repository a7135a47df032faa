"""CRC-32 in SQL, for the SQL of operators whose rows hold one."""

from __future__ import annotations


def _nibbles() -> list[int]:
    out = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def crc32_sql(blob: str) -> str:
    """A DuckDB expression for the unsigned CRC-32 of a blob, which folds the bytes one at a time."""
    table = "[" + ", ".join(f"{x}::UBIGINT" for x in _nibbles()) + "]"
    code = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda p: ((strpos('0123456789ABCDEF', p[1]) - 1) * 16 + strpos('0123456789ABCDEF', p[2]) - 1)::UBIGINT)"
    fold = "s"
    for nibble in ("(b & 15)", "(b >> 4)"):
        fold = f"list_transform([{fold}], lambda q: xor(q >> 4, {table}[(xor(q, {nibble}) & 15)::INT + 1]))[1]"
    return f"xor(list_reduce({code}, lambda s, b: {fold}, 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT"
