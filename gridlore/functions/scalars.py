"""Scalar expressions: region ids, paths, packed positions, names, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dimension codes and names.
DIMENSIONS = {0: "overworld", 1: "nether", 2: "end"}
#: Protocol to data version.
DATA_VERSIONS = {765: 3700, 769: 4189}


#: Names of the row layout's versions, and of segment states.
VERSIONS = {1: "0.0.0.1", 2: "0.1.0.0", 3: "0.1.1.0", 4: "0.1.2.0", 5: "0.1.3.0", 6: "0.1.4.0", 7: "1.0.0.0", 8: "1.0.0.1"}
STATES = {0: "unknown", 1: "new", 2: "old"}


def named(code: Column, names: dict[int, str]) -> Column:
    """The code's name, null if it has none."""
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def shl(value: Column, n: int) -> Column:
    return F.shiftleft(value.cast("long"), n)


def region_id(dim: Column, rx: Column, rz: Column) -> Column:
    low = lambda c: c.cast("long").bitwiseAND(0x1FFFFF)
    return shl(dim, 42).bitwiseOR(shl(low(rx), 21)).bitwiseOR(low(rz))


def region_fields(rid: Column) -> list[Column]:
    """dim, rx, rz with the sign of 21-bit fields restored; an unknown dimension reads as 0."""
    signed = lambda u: F.when(u >= 1 << 20, u - (1 << 21)).otherwise(u).cast("int")
    dim = F.shiftright(rid, 42).cast("int")
    return [F.when(dim.isin(*DIMENSIONS), dim).otherwise(0).alias("dim"), signed(F.shiftright(rid, 21).bitwiseAND(0x1FFFFF)).alias("rx"), signed(rid.bitwiseAND(0x1FFFFF)).alias("rz")]


def sector(rc: Column) -> Column:
    """Division by 32 towards minus infinity."""
    return F.shiftright(rc, 5)


def region_path(dim: Column, rx: Column, rz: Column, suffix: str) -> Column:
    return F.concat_ws("/", dim, sector(rx).cast("string"), sector(rz).cast("string"), F.concat(F.lit("r."), rx.cast("string"), F.lit("."), rz.cast("string"), F.lit(f".{suffix}")))


def parse_file_name(name: Column, suffix: str) -> list[Column]:
    """rx, rz of r.<rx>.<rz>[.more].<suffix>, else nulls."""
    pattern = rf"^r\.([^.]*)\.([^.]*)(?:\..*)?\.{suffix}$"
    part = lambda i: F.nullif(F.regexp_extract(name, pattern, i), F.lit("")).try_cast("int")
    both = part(1).isNotNull() & part(2).isNotNull()
    return [F.when(both, part(1)).alias("rx"), F.when(both, part(2)).alias("rz")]


def pack_position(x: Column, y: Column, z: Column) -> Column:
    return shl(y, 16).bitwiseOR(shl(z, 8)).bitwiseOR(x.cast("long"))


def unpack_position(p: Column) -> list[Column]:
    return [p.bitwiseAND(255).cast("int").alias("x"), F.shiftright(p, 16).cast("int").alias("y"), F.shiftright(p, 8).bitwiseAND(255).cast("int").alias("z")]


def namespaced(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(":")), name).otherwise(F.concat(F.lit("minecraft:"), name))


def parse_dimension(s: Column) -> Column:
    bare = F.regexp_replace(s, "^minecraft:", "")
    return F.when(bare == "overworld", 0).when(bare.isin("nether", "the_nether"), 1).when(bare.isin("end", "the_end"), 2)


def region_folder(dim: Column) -> Column:
    return F.when(dim == 1, "DIM-1/region").when(dim == 2, "DIM1/region").otherwise("region")


def block_base(s: Column) -> Column:
    return F.split_part(s, F.lit("["), F.lit(1))


def block_properties(s: Column) -> Column:
    """Map of base[k=v,...]; '-' and nothing give an empty map, tokens without '=' go, later keys win."""
    inner = F.regexp_extract(s, r"\[([^\]]*)\]?$", 1)
    pairs = F.filter(F.split(inner, ","), lambda t: F.contains(t, F.lit("=")))
    keys = F.transform(pairs, lambda t: F.split_part(t, F.lit("="), F.lit(1)))
    # A key's value is that of its last pair.
    return F.map_from_entries(
        F.transform(
            F.array_distinct(keys),
            lambda k: F.struct(
                k.alias("key"),
                F.try_element_at(F.transform(F.filter(pairs, lambda t: F.split_part(t, F.lit("="), F.lit(1)) == k), lambda t: F.substr(t, F.instr(t, "=") + F.lit(1))), F.lit(-1)).alias("value"),
            ),
        )
    )


def _two_decimals(n: Column, shift: int, unit: str) -> Column:
    """n / 2^shift with two decimals, exact ties to the even digit (the formatter would round them up)."""
    scaled = n.cast("long") * 100
    q, r, half = F.shiftright(scaled, shift), scaled.bitwiseAND((1 << shift) - 1), 1 << (shift - 1)
    q = q + F.when((r > half) | ((r == half) & (q % 2 == 1)), 1).otherwise(0)
    return F.format_string(f"%d.%02d {unit}", F.floor(q / 100), q % 100)


def format_bytes(n: Column, kilo: str = "KB") -> Column:
    """Binary units, two decimals; the CLI writes kB, the benchmark KB."""
    return (
        F.when(n >= 1 << 30, _two_decimals(n, 30, "GB")).when(n >= 1 << 20, _two_decimals(n, 20, "MB"))
        .when(n >= 1 << 10, _two_decimals(n, 10, kilo)).otherwise(F.format_string("%d B", n.cast("long")))
    )


def format_duration(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return F.when(seconds >= 60, F.format_string("%02dm %02ds", F.floor(whole / 60), whole % 60)).otherwise(F.format_string("%.2fs", seconds.cast("double")))


def format_rate(rate: Column, unit: str) -> Column:
    r = rate.cast("double")
    return (
        F.when(r >= 1e9, F.format_string(f"%.2f G{unit}", r / 1e9)).when(r >= 1e6, F.format_string(f"%.2f M{unit}", r / 1e6))
        .when(r >= 1e3, F.format_string(f"%.2f K{unit}", r / 1e3)).otherwise(F.format_string(f"%.2f {unit}", r))
    )


def format_count(n: Column) -> Column:
    return F.format_number(n, 0)
