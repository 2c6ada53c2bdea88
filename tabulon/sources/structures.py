"""Texts of structure files: CIF with all sites written out, and POSCAR."""

from __future__ import annotations

import math
import re


def parsed_structure(path: str, text: str) -> dict | None:
    """A structure as nested values, by the form the file name tells; null if the text can't be read as one."""
    try:
        return _cif(text) if path.lower().endswith(".cif") else _poscar(text)
    except (ValueError, IndexError, KeyError, ZeroDivisionError):
        return None


def _number(text: str) -> float:
    """A number, without its uncertainty in brackets."""
    return float(re.sub(r"\(\d+\)$", "", text))


def _made(lattice: list[float], sites: list[tuple[str, list[float]]]) -> dict:
    if not sites or not all(math.isfinite(x) for x in lattice) or min(lattice) <= 0:
        raise ValueError("no structure")
    return {"lattice": dict(zip(("a", "b", "c", "alpha", "beta", "gamma"), lattice)), "sites": [{"element": e, "frac_coords": f} for e, f in sites]}


def _cif(text: str) -> dict:
    value = {m.group(1).lower(): m.group(2) for m in re.finditer(r"(?m)^(_cell_\w+)\s+(\S+)", text)}
    lattice = [_number(value[f"_cell_{k}"]) for k in ("length_a", "length_b", "length_c", "angle_alpha", "angle_beta", "angle_gamma")]
    for loop in re.split(r"(?m)^loop_\s*$", text)[1:]:
        lines = [x.strip() for x in loop.strip().splitlines()]
        names = [x.split()[0].lower() for x in lines if x.startswith("_")]
        if "_atom_site_fract_x" not in names:
            continue
        place = {n: i for i, n in enumerate(names)}
        kind = place.get("_atom_site_type_symbol", place.get("_atom_site_label"))
        sites = []
        for row in lines[len(names) :]:
            part = row.split()
            if len(part) != len(names):
                break
            element = re.match(r"[A-Z][a-z]?", part[kind])
            sites.append((element.group(), [_number(part[place[f"_atom_site_fract_{k}"]]) for k in "xyz"]))
        return _made(lattice, sites)
    raise ValueError("no sites")


def _poscar(text: str) -> dict:
    lines = text.splitlines()
    scale = float(lines[1])
    m = [[float(x) * scale for x in lines[k].split()[:3]] for k in (2, 3, 4)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    length = [math.sqrt(dot(v, v)) for v in m]
    angle = lambda i, j: math.degrees(math.acos(max(-1.0, min(1.0, dot(m[i], m[j]) / (length[i] * length[j])))))
    names, counts = lines[5].split(), [int(x) for x in lines[6].split()]
    start = 8 if lines[7].strip()[:1].lower() == "s" else 7
    direct = lines[start].strip()[:1].lower() == "d"
    elements = [e for e, n in zip(names, counts) for _ in range(n)]
    rows = [[float(x) for x in lines[start + 1 + i].split()[:3]] for i in range(len(elements))]
    if not direct:
        cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
        volume = dot(m[0], cross(m[1], m[2]))
        rows = [[dot([x * scale for x in r], cross(m[(k + 1) % 3], m[(k + 2) % 3])) / volume for k in range(3)] for r in rows]
    return _made([*length, angle(1, 2), angle(0, 2), angle(0, 1)], list(zip(elements, rows)))
