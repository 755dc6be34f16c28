"""The 20-digit Brazilian case number: NNNNNNN-DD.AAAA.J.TR.OOOO (ISO 7064 MOD 97-10 check digits)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the judiciary's segments and endpoint suffixes of its courts, by code.
SEGMENTS = {
    "1": "STF", "2": "CNJ", "3": "STJ", "4": "Justiça Federal", "5": "Justiça do Trabalho", "6": "Justiça Eleitoral",
    "7": "Justiça Militar da União", "8": "Justiça Estadual", "9": "Justiça Militar Estadual",
}
STATE_COURTS = (
    "ac", "al", "ap", "am", "ba", "ce", "dft", "es", "go", "ma", "mt", "ms", "mg", "pa",
    "pb", "pr", "pe", "pi", "rj", "rn", "rs", "ro", "rr", "sc", "se", "sp", "to",
)
ALIASES = (
    {"3.00": "api_publica_stj"}
    | {f"4.0{n}": f"api_publica_trf{n}" for n in range(1, 7)}
    | {f"8.{n:02d}": f"api_publica_tj{s}" for n, s in enumerate(STATE_COURTS, 1)}
)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def case_digits(value: Column) -> Column:
    """The 20 digits, or null where there are not 20."""
    d = F.regexp_replace(value.cast("string"), r"\D", "")
    return F.when(F.length(d) == 20, d)


def case_number(value: Column) -> Column:
    """Struct of digits, formatted, valid, year, segment, tribunal (J.TR), origin; null where there are not 20 digits."""
    # As a variable of a lambda the digits are looked for once, not once for each part of each field.
    return F.get(F.transform(F.array(case_digits(value)), _numbered), F.lit(0))


def _numbered(d: Column) -> Column:
    seq, check, year, segment, court, origin = (F.substring(d, a, n) for a, n in ((1, 7), (8, 2), (10, 4), (14, 1), (15, 2), (17, 4)))
    tribunal = F.concat(segment, F.lit("."), court)
    return F.when(
        d.isNotNull(),
        F.struct(
            d.alias("digits"),
            F.concat(seq, F.lit("-"), check, F.lit("."), year, F.lit("."), segment, F.lit("."), court, F.lit("."), origin).alias("formatted"),
            (check.cast("int") == check_digits(seq, year, segment, court, origin)).alias("valid"),
            year.cast("int").alias("year"),
            segment.alias("segment"),
            tribunal.alias("tribunal"),
            origin.alias("origin"),
        ),
    )


def check_digits(seq: Column, year: Column, segment: Column, court: Column, origin: Column) -> Column:
    """98 - (N mod 97) with N the number without its check digits, times 100: past 64 bits, so in decimal."""
    base = F.concat(seq, year, segment, court, origin, F.lit("00")).cast("decimal(38,0)")
    return (F.lit(98) - (base % F.lit(97))).cast("int")


def segment_name(segment: Column) -> Column:
    return F.coalesce(_lookup(SEGMENTS, segment), F.lit("desconhecido"))


def endpoint_alias(tribunal: Column) -> Column:
    """Public endpoint of a court (J.TR), null for courts without one."""
    return _lookup(ALIASES, tribunal)
