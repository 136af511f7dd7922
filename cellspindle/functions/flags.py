"""SAM flag policies of the operators, as documented for each command."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bits of a SAM flag.
UNMAPPED, REVERSE, READ1, READ2, SECONDARY, QCFAIL, DUPLICATE, SUPPLEMENTARY = 4, 16, 64, 128, 256, 512, 1024, 2048

EXCLUDED = {
    "count": UNMAPPED | DUPLICATE,
    "count_with_duplicates": UNMAPPED,
    "depth": SECONDARY | UNMAPPED | QCFAIL | DUPLICATE,
    "correct": QCFAIL | SECONDARY | SUPPLEMENTARY | UNMAPPED | DUPLICATE,
    "pick": QCFAIL | SECONDARY,
    "attributes": SECONDARY,
    "rmdup": QCFAIL | SECONDARY | SUPPLEMENTARY,
    "fragments": UNMAPPED | SECONDARY | SUPPLEMENTARY | READ2,
}


def passes(policy: str, flag: Column | str = "flag") -> Column:
    """Rows a command keeps; a null flag has no bits."""
    f = F.col(flag) if isinstance(flag, str) else flag
    return F.coalesce(f, F.lit(0)).bitwiseAND(EXCLUDED[policy]) == 0


def has(bit: int, flag: Column | str = "flag") -> Column:
    f = F.col(flag) if isinstance(flag, str) else flag
    return F.coalesce(f, F.lit(0)).bitwiseAND(bit) != 0


def read_strand(flag: Column | str = "flag", flip_read2: bool = True) -> Column:
    """`+` or `-` of the fragment: the second read of a pair counts as its mate."""
    reverse = has(REVERSE, flag)
    return F.when(reverse != has(READ2, flag), "-").otherwise("+") if flip_read2 else F.when(reverse, "-").otherwise("+")
