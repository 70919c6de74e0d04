"""Integers and access rights."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CREATE_THREAD, VM_OPERATION, VM_WRITE, CREATE_PROCESS = 0x2, 0x8, 0x20, 0x80
ALL_ACCESS = (0x1FFFFF, 0x1F0FFF)


def integer(c: Column) -> Column:
    """Up to 15 decimal digits, or 0x and up to 12 hexadecimal ones."""
    s = F.trim(c)
    return F.when(s.rlike("^[0-9]{1,15}$"), s.try_cast("long")).when(s.rlike("(?i)^0x[0-9a-f]{1,12}$"), F.conv(F.substring(s, 3, 12), 16, 10).cast("long"))


def has(mask: Column, bits: int) -> Column:
    return mask.bitwiseAND(F.lit(bits).cast("long")) == bits


def injection_capable(mask: Column) -> Column:
    """Rights to write code into a process or to start a thread in it."""
    return has(mask, ALL_ACCESS[0]) | has(mask, ALL_ACCESS[1]) | has(mask, CREATE_THREAD) | has(mask, VM_WRITE | VM_OPERATION)


def hexadecimal(mask: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(mask)))
