"""Times and amounts for people, and whole numbers in as few bytes as they need."""

from __future__ import annotations


def duration(seconds: float) -> str:
    """Days, hours, minutes and seconds, without those that lead with zero."""
    whole = int(seconds)
    days, hours, minutes, rest = whole // 86400, whole // 3600 % 24, whole // 60 % 60, whole % 60
    parts = [f"{n}{u}" for n, u in ((days, "d"), (hours, "h"), (minutes, "m")) if n]
    return " ".join([*parts, f"{rest}s"]) if parts else f"{seconds:.2f}s".replace(".00s", "s")


def amount(n: float, unit: str = "B") -> str:
    """A number with the prefix that leaves one to three digits before the point."""
    for prefix in ("", "K", "M", "G", "T"):
        if abs(n) < 1000 or prefix == "T":
            return f"{n:.0f} {unit}" if not prefix else f"{n:.1f} {prefix}{unit}"
        n /= 1000
    raise AssertionError


def packed_ints(numbers: list[int]) -> bytes:
    """Each number as its least bytes, after one byte that tells how many."""
    out = bytearray()
    for n in numbers:
        if n < 0:
            raise ValueError("only numbers from zero on can be packed")
        size = (n.bit_length() + 7) // 8
        out += bytes([size]) + n.to_bytes(size, "little")
    return bytes(out)


def unpacked_ints(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        size = data[at]
        out.append(int.from_bytes(data[at + 1 : at + 1 + size], "little"))
        at += 1 + size
    return out


def mismatch_combinations(distance: int, alpha: int) -> list[tuple[int, int]]:
    """(a, g) with a * alpha + g <= distance, the cheapest first: a differences of one kind at a cost of alpha, g of another at one each."""
    found = [(a, g) for a in range(distance // alpha + 1) for g in range(distance - a * alpha + 1)]
    return sorted(found, key=lambda x: (x[0] * alpha + x[1], x))
