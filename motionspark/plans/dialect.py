"""The few spots at which SQL engines differ. Plans are written once and rendered for an engine."""

from __future__ import annotations


class Spark:
    """Spark SQL over the Parquet tables of a folder."""

    def __init__(self, folder: str):
        self.folder = folder

    def table(self, name: str) -> str:
        return f"parquet.`{self.folder}/{name}.parquet`"

    def numbers(self, lo: int, hi: int, name: str) -> str:
        """A lateral row source of the integers lo..hi, to follow a FROM item."""
        return f"LATERAL VIEW explode(sequence({lo}, {hi})) AS {name}"

    def nth(self, x: str, when: str, index: str) -> str:
        """Aggregate: element of the sorted values of x (where ``when`` holds) by a zero-based index; n is their number."""
        values = f"sort_array(collect_list(CASE WHEN {when} THEN {x} END))"
        n = f"count(CASE WHEN {when} THEN {x} END)"
        return f"try_element_at({values}, CAST({index.replace('{n}', n)} AS INT) + 1)"

    def percentile(self, x: str, p: str) -> str:
        return f"percentile({x}, {p})"

    def scrambled(self, x: str) -> str:
        """x * 1103515245 + 12345 modulo 2**31 for a whole x from 0, which is reduced first: the product of a key over a million does not fit 64 bits."""
        return f"(({x}) % 2147483648 * 1103515245 + 12345) % 2147483648"

    def values(self, rows: list[str], columns: str) -> str:
        return f"(VALUES {', '.join(rows)}) AS v({columns})"


class Duck(Spark):
    """DuckDB, for the oracle."""

    def __init__(self):
        pass

    def table(self, name: str) -> str:
        return name

    def numbers(self, lo: int, hi: int, name: str) -> str:
        return f", (SELECT unnest(range({lo}, {hi} + 1)) AS {name}) AS numbers_{name}"

    def nth(self, x: str, when: str, index: str) -> str:
        n = f"count(CASE WHEN {when} THEN {x} END)"
        return f"list_sort(list({x}) FILTER (WHERE ({when}) AND {x} IS NOT NULL))[CAST({index.replace('{n}', n)} AS INT) + 1]"

    def percentile(self, x: str, p: str) -> str:
        return f"quantile_cont({x}, {p})"

    def scrambled(self, x: str) -> str:
        return f"(({x}) * 1103515245 + 12345) % 2147483648"


def upper_median(d: Spark, x: str, when: str = "1 = 1") -> str:
    return d.nth(x, when, "floor({n} / 2)")


def rounded(x: str, places: int = 4) -> str:
    """Half up, by the same arithmetic in every engine."""
    return f"floor(({x}) * 1e{places} + 5e-1) / 1e{places}"


def length(x: str, y: str) -> str:
    return f"sqrt(({x}) * ({x}) + ({y}) * ({y}))"


def line_sums(p: str, x: str, y: str, when: str) -> str:
    """Aggregates for an OLS line of y on x, named by the prefix ``p``."""
    terms = {"0": "1e0", "1": x, "2": f"({x}) * ({x})", "y0": y, "y1": f"({x}) * ({y})", "yy": f"({y}) * ({y})"}
    return ", ".join(f"sum(CASE WHEN {when} THEN {v} END) AS {p}{k}" for k, v in terms.items())


def line_fit(p: str, least: int = 2) -> tuple[str, str, str]:
    """(intercept, slope, rms) from line_sums; null below ``least`` points or if x does not vary."""
    den = f"({p}0 * {p}2 - {p}1 * {p}1)"
    ok = f"CASE WHEN {p}0 >= {least} AND abs({den}) >= 1e-12 THEN"
    b = f"{ok} ({p}0 * {p}y1 - {p}1 * {p}y0) / {den} END"
    a = f"{ok} ({p}y0 - {p}1 * (({p}0 * {p}y1 - {p}1 * {p}y0) / {den})) / {p}0 END"
    rms = f"sqrt(greatest(0e0, ({p}yy - ({a}) * {p}y0 - ({b}) * {p}y1) / {p}0))"
    return a, b, rms


def quad_sums(p: str, x: str, y: str, when: str) -> str:
    """Aggregates for a least-squares parabola of y on x, named by the prefix ``p``."""
    powers = ["1e0", f"({x})", f"({x}) * ({x})", f"({x}) * ({x}) * ({x})", f"({x}) * ({x}) * ({x}) * ({x})"]
    sums = [f"sum(CASE WHEN {when} THEN {v} END) AS {p}{k}" for k, v in enumerate(powers)]
    return ", ".join([*sums, *(f"sum(CASE WHEN {when} THEN ({y}) * {powers[k]} END) AS {p}y{k}" for k in range(3))])


def quad_fit(p: str, least: int = 3) -> tuple[str, str, str]:
    """(a, b, c) of a + b x + c x**2 from quad_sums by Cramer's rule; null if there is no unique one."""

    def det(m: list[str]) -> str:
        return f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"

    rows = [f"{p}{i + j}" for i in range(3) for j in range(3)]
    right = [f"{p}y{i}" for i in range(3)]
    ok = f"CASE WHEN {p}0 >= {least} AND abs({det(rows)}) > 1e-10 * {p}0 * {p}2 * {p}4 THEN"
    return tuple(f"{ok} {det([right[i // 3] if i % 3 == k else rows[i] for i in range(9)])} / {det(rows)} END" for k in range(3))
