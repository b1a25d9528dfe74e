import math
import random

import pytest

from corpusloom.functions import graphs
from corpusloom.operators import structures as op
from corpusloom.sources import cif, files

# Acetylsalicylic acid, elements and places in Angstrom.
ASPIRIN = """C 2.05639 -0.16543 0.39727
C 0.68890 2.02854 -0.64816
C 2.74071 1.02327 0.12533
C 2.05734 2.11782 -0.40016
C -3.59396 1.03209 0.04589
C 0.67738 -0.27507 0.15097
C 0.00274 0.84234 -0.35887
O 0.63293 -2.54526 0.93360
O -1.76452 1.43252 1.56571
O -1.24894 -1.68411 0.12975
C 0.05278 -1.58881 0.44958
C -2.15199 1.12841 0.44513
O -1.36167 0.82832 -0.65825
H -1.47652 -2.60111 0.39232
H 2.60948 -1.01173 0.80284
H 0.15708 2.88266 -1.05823
H 3.80777 1.09126 0.32364
H 2.59044 3.04081 -0.61405
H -3.81640 0.02049 -0.30287
H -4.22480 1.24591 0.91440
H -3.81296 1.76576 -0.73332"""
ATOMS = "array<struct<sym:string,x:double,y:double,z:double>>"


def atoms_of(text):
    return [(c[0], *map(float, c[1:])) for c in map(str.split, text.splitlines())]


def test_aspirin_from_xyz_to_sdf(spark, tmp_path):
    (tmp_path / "a.xyz").write_text(f"21\naspirin\n{ASPIRIN}\n")
    found = op.with_bonds(files.read_xyz(spark, str(tmp_path / "a.xyz")))
    r = found.first()
    assert len(r["atoms"]) == 21 and len(r["bonds"]) == 21 and sorted(b["order"] for b in r["bonds"]) == [1] * 16 + [2] * 5
    key = found.select(graphs.structure_key("atoms", "bonds")).first()[0]
    assert key == graphs.key(graphs.parse("CC(=O)Oc1ccccc1C(=O)O"))
    ready = found.selectExpr("comment AS name", "atoms", "bonds", "map('k', 'v') AS props")
    files.write_sdf(ready, str(tmp_path / "out"))
    back = files.read_sdf(spark, str(tmp_path / "out")).first()
    assert [tuple(b) for b in back["bonds"]] == [tuple(b) for b in r["bonds"]] and back["props"] == {"k": "v"} and len(back["atoms"]) == 21


def plain_bonds(atoms):
    """All pairs by distance, then the shortest that an atom can have."""
    radius = lambda s: op.RADII.get(s, op.OTHER_RADIUS)
    near = []
    for j in range(len(atoms)):
        for i in range(j):
            d = math.dist(atoms[i][1:], atoms[j][1:])
            if op.LEAST < d < radius(atoms[i][0]) + radius(atoms[j][0]) + op.SLACK:
                near.append((d, i, j))
    kept = set(near)
    for k, (sym, *_) in enumerate(atoms):
        own = sorted((d, j if i == k else i, (d, i, j)) for d, i, j in near if k in (i, j))
        kept -= {x for _, _, x in own[op.AT_MOST.get(sym, op.MOST_BONDS) :]}
    return sorted((i + 1, j + 1) for _, i, j in kept)


def test_bonds_as_by_all_pairs(spark):
    rng = random.Random(0)
    some = [[(rng.choice(["C", "H", "O", "N", "Cs", "Qq", "Br"]), *(rng.uniform(-size, size) for _ in range(3))) for _ in range(n)] for n, size in ((0, 1), (1, 1), (60, 4), (300, 6), (40, 1))]
    rows = [(k, a, "old") for k, a in enumerate(some)] + [(9, None, "old"), (10, [("C", None, 0.0, 0.0), ("C", 0.0, 0.0, 0.0), ("C", 1.5, 0.0, 0.0)], "old")]
    df = spark.createDataFrame(rows, f"_at int, atoms {ATOMS}, bonds string")
    got = {r["_at"]: r["bonds"] for r in op.with_bonds(df.repartition(3)).collect()}
    for k, a in enumerate(some):
        assert [(b["a"], b["b"]) for b in got[k]] == plain_bonds(a)
    assert got[9] is None and [tuple(b) for b in got[10]] == [(2, 3, 1)]
    assert op.orders(["C", "C"], [(1, 2, 1.2)]) == [3] and op.orders(["C", "C"], [(1, 2, 1.34)]) == [2]
    tight = {r["_at"]: r["bonds"] for r in op.with_bonds(df.filter("_at = 10"), cell=2.0).collect()}
    assert tight[10] == got[10]


def test_time_follows_the_atoms(spark):
    """A long chain: each atom meets a bounded number of others."""
    n = 6_000
    df = spark.createDataFrame([([("C", 1.5 * k, 0.0, 0.0) for k in range(n)],)], f"atoms {ATOMS}")
    bonds = op.with_bonds(df).first()["bonds"]
    assert [(b["a"], b["b"]) for b in bonds] == [(k, k + 1) for k in range(1, n)]


@pytest.mark.parametrize("text", ["C=C", "C#C", "N#CC", "O=C=O", "c1ccccc1", "c1ccc2ccccc2c1", "C1=CC=CC1", "CC(=O)O", "C=CC=CC=C", "CS(C)(=O)=O", "c1ccc2c(c1)ccc1ccccc12", "C1=CC2=CC=CC2=C1", "N=C=O", "CP(=O)(O)O"])
def test_orders_fill_valences(text):
    """Orders found from the connections alone leave each atom the hydrogens that the string gives it."""
    g = graphs.parse(text)
    symbols = [e for e, _, _ in g.atoms]
    pairs = sorted((i + 1, j + 1) for i, near in enumerate(g.near) for j in near if i < j)
    hydrogens = []
    for i, (_, _, h) in enumerate(g.atoms):
        for _ in range(h):
            symbols.append("H")
            hydrogens.append((i + 1, len(symbols)))
    bonds = [(a, b, 1.15) for a, b in pairs] + [(a, b, 1.0) for a, b in hydrogens]
    found = op.orders(symbols, bonds)
    for i, (e, _, h) in enumerate(g.atoms):
        assert sum(o for (a, b, _), o in zip(bonds, found) if i + 1 in (a, b)) in op.VALENCES[e]


CIF = """#comment 'not' a value
data_first
_publ_section_title
;
A text field with data_ and loop_ and 'quotes'
_cell_length_a 99
;
_cell_length_a   10.0(3)
_cell_length_b   6.0
_cell_length_c   8.0(10)
_cell_angle_alpha 90.00
_cell_angle_beta 120.00
_cell_angle_gamma 90
_note 'it''s a dog's life' # a quote within
loop_
_symmetry_equiv_pos_as_xyz
'x, y, z'
'-x, y+1/2, -z+1/2'
-x,-y,-z
'x, -y-1/2, z-1/2'
loop_
_atom_site_aniso_label
_atom_site_aniso_U_11
C1 0.1
loop_
_atom_site_label
_atom_site_type_symbol
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
C1 C 0.25(2) 0.5 0.1
Zn2 Zn2+ 0.0 0.0 0.0
H3 H ? 0.5 .
loop_
_other_a
_other_b
1 'two
three'
data_second
_cell_length_a 5
data_third
loop_
_atom_site_label
_atom_site_Cartn_x
_atom_site_Cartn_y
_atom_site_Cartn_z
O1A 1.0 2.0 3.0
"""


def test_cif_in_full(spark, tmp_path):
    (tmp_path / "a.cif").write_text(CIF)
    got = {r["block"]: r for r in cif.read_cif(spark, str(tmp_path / "a.cif")).collect()}
    assert set(got) == {"first", "second", "third"} and got["first"]["cell"] == [10, 6, 8, 90, 120, 90]
    assert got["second"]["cell"] is None and got["second"]["atoms"] is None
    assert [tuple(a) for a in got["third"]["atoms"]] == [("O1A", "O", 1.0, 2.0, 3.0)]
    c, zn, h = got["first"]["atoms"]
    assert (c["sym"], zn["sym"], h["sym"]) == ("C", "Zn", "H") and tuple(h)[2:] == (None, None, None)
    x, y, z = tuple(c)[2:]
    assert (x, y, z) == pytest.approx((0.25 * 10 - 0.1 * 8 * 0.5, 3.0, 0.1 * 8 * math.sin(math.radians(120))))
    full = {r["block"]: r for r in cif.read_cif(spark, str(tmp_path / "a.cif"), expand=True).collect()}["first"]["atoms"]
    # four places of C1, two of the zinc on a centre, the hydrogen without place once
    assert [a["sym"] for a in full].count("C") == 4 and [a["sym"] for a in full].count("Zn") == 2 and [a["sym"] for a in full].count("H") == 1


@pytest.mark.parametrize("text,point,want", [("x,y,z", (0.1, 0.2, 0.3), (0.1, 0.2, 0.3)), ("-Y, X-Y , z+1/3", (0.1, 0.2, 0.3), (-0.2, -0.1, 0.3 + 1 / 3)), ("1/2+x,.5-y,-z", (0.1, 0.2, 0.3), (0.6, 0.3, -0.3)), ("2*x,y,z", (0.1, 0.2, 0.3), (0.2, 0.2, 0.3))])
def test_operators(text, point, want):
    m, s = cif.operator(text)
    assert tuple(m @ point + s) == pytest.approx(want)
    assert cif.operator("x,y") is None and cif.operator("x,y,q") is None


def test_cells():
    a = cif.axes([3.0, 4.0, 5.0, 80.0, 95.0, 110.0])
    length = [float((a[:, k] ** 2).sum() ** 0.5) for k in range(3)]
    angle = lambda i, j: math.degrees(math.acos(float(a[:, i] @ a[:, j]) / length[i] / length[j]))
    assert length == pytest.approx([3, 4, 5]) and (angle(1, 2), angle(0, 2), angle(0, 1)) == pytest.approx((80, 95, 110))
    assert cif.axes([1, 1, 1, 10, 10, 170]) is None


def test_contacts_meet_without_a_broadcast(spark, monkeypatch):
    """Each atom's places in the neighbouring cells are many times their table: a broadcast of them filled the driver. A pair in neighbouring cells meets once, whichever atom comes first."""
    plans, staged = {}, op.staged

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return staged(df, name)

    monkeypatch.setattr(op, "staged", kept)
    cell = op.CELL
    rows = [(k, pos, "C", side * s, side * t, side * u) for k, (s, t, u) in enumerate([(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, -1, 0), (1, 1, -1)]) for pos, side in enumerate((cell + 0.4, cell - 0.4) if k % 2 else (cell - 0.4, cell + 0.4))]
    found = op.contacts(spark.createDataFrame(rows, "sid int, pos int, sym string, x double, y double, z double"), "sid").collect()
    assert sorted((r["sid"], r["a"], r["b"]) for r in found) == [(k, 1, 2) for k in range(5)]
    assert "Broadcast" not in plans["near"]
