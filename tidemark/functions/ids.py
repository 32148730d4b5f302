"""Identity of identifiers and operations that several relays write differently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a blank at the ends of an identifier.
BLANKS = " \t\n\r\x0b\x0c"
#: The writings of the two operations, after trimming and lower case.
PUTS, DELETES = ("put", "roput"), ("delete", "rodelete")


def same_id(c: Column) -> Column:
    """The form in which two writings of an identifier are equal (case, blanks at the ends); null stays null."""
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def op_kind(c: Column) -> Column:
    """'put', 'delete', or null for anything else."""
    o = same_id(c)
    return F.when(o.isin(*PUTS), "put").when(o.isin(*DELETES), "delete")


def hlc_order(c: Column) -> Column:
    """A struct that orders by wall, counter, node (bytewise); below all others where the clock is null.

    A clock with a null part counts as older in that part.
    """
    return F.struct(
        c.isNotNull().alias("has"),
        c["wall"].alias("wall"),
        c["counter"].alias("counter"),
        c["node"].alias("node"),
    )
