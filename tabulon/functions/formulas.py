"""Chemical formulas and systems as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The symbols of the elements.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr "
    "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()

#: Counts beyond this many digits are no formula.
DIGITS = 4


def plain_digits(text: Column) -> Column:
    """Subscript and full-width digits as ordinary ones."""
    return F.translate(text, "₀₁₂₃₄₅₆₇₈₉０１２３４５６７８９", "01234567890123456789")


def composition(formula: Column) -> Column:
    """Formula text -> composition key such as ``Ge1-Rb2-Te3``: counts over their greatest common divisor, elements sorted.

    Blanks and the form of digits don't matter, repeated elements add up. Null if the text is null or isn't
    wholly symbols and counts (of at most DIGITS digits, not 0).
    """
    text = F.regexp_replace(plain_digits(formula), r"[\s ]+", "")
    good = text.rlike(rf"^([A-Z][a-z]?\d{{0,{DIGITS}}})+$") & ~text.rlike(r"[A-Za-z]0")

    def pairs(t: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(t, F.lit(r"([A-Z][a-z]?)(\d*)"), 2), lambda n: F.when(n == "", F.lit(1)).otherwise(n.try_cast("int")))
        return F.arrays_zip(F.regexp_extract_all(t, F.lit(r"([A-Z][a-z]?)(\d*)"), 1).alias("e"), numbers.alias("n"))

    def totals(zipped: Column) -> Column:
        elements = F.array_sort(F.array_distinct(F.transform(zipped, lambda p: p["e"])))
        add = lambda e: F.aggregate(zipped, F.lit(0), lambda acc, p: acc + F.when(p["e"] == e, p["n"]).otherwise(F.lit(0)))
        return F.transform(elements, lambda e: F.struct(e.alias("e"), add(e).alias("n")))

    def reduced(whole: Column) -> Column:
        least = F.array_min(F.transform(whole, lambda t: t["n"]))
        divisor = F.array_max(F.filter(F.sequence(F.lit(1), least), lambda d: F.forall(whole, lambda t: t["n"] % d == 0)))
        return let(divisor, lambda d: F.array_join(F.transform(whole, lambda t: F.concat(t["e"], (t["n"] / d).cast("int").cast("string"))), "-"))

    return F.when(good, let(let(let(text, pairs), totals), reduced))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, as a lambda's variable."""
    return F.transform(F.array(value), body)[0]


def chemical_system(written: Column) -> Column:
    """Any spelling of a set of elements -> sorted symbols joined by ``-``; null if there is none.

    Separated parts are symbols in any case (``ge/rb/te``); unseparated text is read by its capitals (``GeRbTe``).
    """
    cased = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1)))
    camel = lambda p: F.transform(F.regexp_extract_all(p, F.lit(r"([A-Z][a-z]?|[a-z]+)"), 1), lambda x: F.initcap(x))
    alone = lambda p: F.when(p.rlike("^[a-z]{1,2}$"), F.array(cased(p))).otherwise(camel(p))
    several = lambda parts: F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= 2, F.array(cased(p))).otherwise(camel(p))))
    symbols = lambda parts: F.when(F.size(parts) == 1, alone(parts[0])).otherwise(several(parts))
    parts = F.filter(F.split(F.regexp_replace(written, r"[0-9₀-₉]+", " "), r"[^A-Za-z]+"), lambda p: p != "")
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(let(parts, symbols))), "-"), F.lit(""))


def formula_in_name(name: Column) -> Column:
    """The first part of a name, cut at signs, that is a formula of two or more symbols; null if none is."""
    symbols = "|".join(sorted(ELEMENTS, key=lambda e: (-len(e), e)))
    parts = F.split(plain_digits(name), r"[^A-Za-z0-9]+")
    return F.try_element_at(F.filter(parts, lambda p: p.rlike(rf"^(?:(?:{symbols})\d*){{2,}}$")), F.lit(1))


def group_number_in_name(name: Column) -> Column:
    """The space group number written after ``sg`` in a name; null if none is."""
    return F.regexp_extract(name, r"(?i)sg[-_ ]?(\d{1,3})", 1).try_cast("int")


def running_number_in_name(name: Column) -> Column:
    """The longest number that stands alone in a name (also after ``n``, ``no`` or ``#``), without leading zeros; null if none.

    Numbers of space groups, and the digits of screw axes such as P6_3, are none.
    """
    bare = F.regexp_replace(F.regexp_replace(plain_digits(name), r"(?i)sg[-_ ]?\d+", "~"), r"(?<![A-Za-z0-9])[PIFCRA]\d_\d(?!\d)", "~")
    numbers = F.regexp_extract_all(bare, F.lit(r"(?:^|[^A-Za-z0-9])(?:no|n)?(\d+)(?![A-Za-z0-9])"), 1)
    longest = F.array_max(F.transform(numbers, lambda n: F.length(n)))
    first = F.try_element_at(F.filter(numbers, lambda n: F.length(n) == longest), F.lit(1))
    return F.regexp_replace(first, r"^0+(?=\d)", "")


#: The numbers of the noble gases, which end the periods.
PERIOD_ENDS = (2, 10, 18, 36, 54, 86, 118)
PROPERTIES = ("number", "mass", "electronegativity", "period", "group")


def element_properties(given: dict[str, dict[str, float]] | None = None) -> dict[str, list[float]]:
    """PROPERTIES by symbol. Number, period and group follow from the place in the table. Mass and electronegativity are
    estimates by rule (the valley of stable nuclei; outer electrons over the period) where ``given`` has no value."""
    out = {}
    for z, symbol in enumerate(ELEMENTS, 1):
        period = next(i for i, end in enumerate(PERIOD_ENDS, 1) if z <= end)
        start = PERIOD_ENDS[period - 2] if period > 1 else 0
        place, size = z - start, PERIOD_ENDS[period - 1] - start
        if size == 2:
            group = 1 if place == 1 else 18
        elif size == 8:
            group = place if place <= 2 else place + 10
        elif size == 18:
            group = place
        else:
            group = place if place <= 2 else 3 if place <= 16 else place - 14
        mass = 1.0 if z == 1 else 2.0 * z
        for _ in range(40):
            mass = z * (1.98 + 0.0155 * mass ** (2 / 3)) if z > 1 else 1.0
        outer = group if group <= 12 else group - 10
        known = (given or {}).get(symbol, {})
        out[symbol] = [float(z), float(known.get("mass", mass)), float(known.get("electronegativity", round(0.7 + 0.45 * outer ** 0.8 / period**0.5, 4))), float(period), float(group)]
    return out


def composition_statistics(elements: Column, weights: Column, properties: dict[str, list[float]] | None = None) -> dict[str, Column]:
    """For each of PROPERTIES the mean by weights, population deviation of the distinct elements, least and greatest value.

    ``elements``: distinct symbols; ``weights``: their numbers. Null where a symbol is unknown or there is none.
    """
    table = properties or element_properties()
    known = F.map_from_arrays(F.array(*[F.lit(e) for e in table]), F.array(*[F.array(*[F.lit(v) for v in row]) for row in table.values()]))
    rows = F.transform(elements, lambda e: known[e])
    good = (F.size(elements) > 0) & ~F.exists(rows, lambda r: r.isNull())
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    out = {}

    def four(name: str, place: int) -> None:
        v = F.transform(rows, lambda r: F.element_at(r, place))
        n = F.size(v)
        squares = let(total(v) / n, lambda m: F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) ** 2))
        out[f"{name}_weighted_mean"] = F.when(good, total(F.zip_with(v, weights, lambda x, w: x * w)) / total(F.transform(weights, lambda w: w.cast("double"))))
        out[f"{name}_std"] = F.when(good, F.sqrt(squares / n))
        out[f"{name}_min"] = F.when(good, F.array_min(v))
        out[f"{name}_max"] = F.when(good, F.array_max(v))

    for i, name in enumerate(PROPERTIES, 1):
        four(name, i)
    return out


def formula_parts(formula: Column) -> tuple[Column, Column]:
    """Distinct symbols of a composition key (``Ge1-Rb2``), and their numbers."""
    key = F.split(composition(formula), "-")
    return F.transform(key, lambda p: F.regexp_extract(p, r"^([A-Z][a-z]?)", 1)), F.transform(key, lambda p: F.regexp_extract(p, r"(\d+)$", 1).cast("int"))
