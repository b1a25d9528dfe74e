"""Coordinate-annotated structure strings: tokens, stripping, encoding, decoding, bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import truncate_fixed

# The elements' symbols of two letters, by period.
TWO_LETTERS = (
    "He Li Be Ne Na Mg Al Si Cl Ar Ca Sc Ti Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
#: Fixed value: symbols that are written without brackets, and hydrogen counts on carbon, within brackets.
_ORGANIC = r"\[(?:([Cc])H\d*|(Cl|Br|[BCNOPSFIbcnops]))\]"
#: Tokens of plain strings: bracket atoms, two-digit ring numbers, bonds, branches, dots, digits, elements, aromatics.
PLAIN = r"\[[^\]]+\]|%\d{2,}|[=#:/\\-]|[()]|\.|\d|Cl|Br|[BCNOPSFIH]|[cnopsb]"
#: Tokens of enriched strings: atoms carry coordinates.
ENRICHED = r"\[[^\]]+\]<[^>]*>|%\d{2,}|[=#:/\\-]|[()]|\d|\."
#: Fixed value: a decimal number.
NUMBER = r"[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?"


def strip_text(s: Column) -> Column:
    """The plain string of an enriched one: no white space or coordinates, no brackets around organic atoms, no hydrogen counts on carbon."""
    bare = F.regexp_replace(F.regexp_replace(s, r"\s+", ""), r"<[^>]*>", "")
    return F.regexp_replace(bare, _ORGANIC, "$1$2")


def _tokens(s: Column, pattern: str) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(0))


def tokenize_plain(s: Column) -> Column:
    """array<struct<type, text>>, or null if some character belongs to no token."""
    found = _tokens(s, PLAIN)
    kinds = F.transform(found, lambda t: F.struct(F.when(t.rlike(r"^(\[|[A-Za-z])"), "atom").otherwise("nonatom").alias("type"), t.alias("text")))
    return F.when(F.length(F.array_join(found, "")) == F.length(s), kinds)


#: Pieces of plain strings that an element may begin: a capital and up to two small letters, or whatever PLAIN has.
_STEERED = r"\[[^\]]+\]|%\d{2,}|[=#:/\\-]|[()]|\.|\d|[A-Z][a-z]{0,2}|[a-z]"


def tokenize_steered(s: Column, expected: Column | None = None) -> Column:
    """array<struct<type, text>> of a plain string whose letters may split in several ways: ``Sc`` as scandium or as S and c, ``Cn``, ``Co`` likewise.

    ``expected`` has the symbols of all atoms in order, bracket atoms included; the split that spells them is taken, and
    there is none (null) if they can't be spelt. A capital letter begins one atom and a small one behind it ends that or is an aromatic atom, so that each place has one split
    that its own atom allows. Without ``expected`` the longest symbol that there is wins. Null if some character belongs to no token."""
    found = _tokens(s, _STEERED)
    two = F.array(*map(F.lit, TWO_LETTERS))
    token = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    none = F.array().cast("array<struct<type:string,text:string>>")

    def step(state: Column, piece: Column) -> Column:
        at, out = state["at"], state["out"]
        head = F.substring(piece, 1, 2)
        wanted = F.try_element_at(expected, at + 1) if expected is not None else None
        whole = (F.length(head) == 2) & F.array_contains(two, head) & (F.lit(True) if wanted is None else F.coalesce(wanted == head, F.lit(False)))
        first = F.when(whole, head).otherwise(F.substring(piece, 1, 1))
        rest = F.filter(F.split(F.substring(piece, F.length(first) + 1, F.lit(3)), ""), lambda c: c != "")
        letters = F.concat(F.array(first), rest)
        atoms = F.when(piece.startswith("["), F.array(piece)).when(piece.rlike("^[A-Za-z]"), letters)
        new = F.when(atoms.isNull(), F.array(token("nonatom", piece))).otherwise(F.transform(atoms, lambda a: token("atom", a)))
        return F.struct((at + F.coalesce(F.size(atoms), F.lit(0))).alias("at"), F.concat(out, new).alias("out"))

    end = F.aggregate(found, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda state, piece: step(state, piece))["out"]
    plain = rf"^([A-Z]|[bcnops]|{'|'.join(TWO_LETTERS)}|\[.*\])$"
    atoms = F.filter(end, lambda t: t["type"] == "atom")
    ok = (F.length(F.array_join(found, "")) == F.length(s)) & F.forall(atoms, lambda t: t["text"].rlike(plain))
    if expected is not None:
        same = lambda t, w: (t["text"] == w) | (t["text"].startswith("[") & F.contains(t["text"], w))
        ok = ok & (F.size(atoms) == F.size(expected)) & F.forall(F.zip_with(atoms, expected, lambda t, w: F.coalesce(same(t, w), F.lit(False))), lambda x: x)
    return F.when(ok, end)


def annotate(s: Column, coords: Column, expected: Column | None = None, places: int = 4) -> Column:
    """A plain string with its atoms' coordinates (array<array<double>>, in order) behind them, every atom in brackets; null if the string doesn't parse or has not as many atoms."""
    tokens = tokenize_steered(s, expected)
    numbers = lambda p: F.concat(F.lit("<"), F.array_join(F.transform(p, lambda v: truncate_fixed(v, places)), ","), F.lit(">"))
    bracket = lambda t: F.when(t.startswith("["), t).otherwise(F.concat(F.lit("["), t, F.lit("]")))

    def step(state: Column, t: Column) -> Column:
        atom = t["type"] == "atom"
        text = F.when(atom, F.concat(bracket(t["text"]), numbers(F.element_at(coords, state["at"] + 1)))).otherwise(t["text"])
        return F.struct((state["at"] + atom.cast("int")).alias("at"), F.concat(state["out"], text).alias("out"))

    fits = F.size(F.filter(tokens, lambda t: t["type"] == "atom")) == F.size(coords)
    return F.when(fits, F.aggregate(tokens, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)["out"])


def parse_coords(token: Column) -> Column:
    """The three numbers of an atom token as doubles, each the last number of its part; null if there aren't three."""
    parts = F.split(F.regexp_extract(token, "<([^>]*)>", 1), ",")
    numbers = F.transform(parts, lambda p: F.try_element_at(_tokens(p, NUMBER), F.lit(-1)).cast("double"))
    return F.when((F.size(parts) == 3) & F.forall(numbers, lambda n: n.isNotNull()), numbers)


def tokenize_enriched(s: Column) -> Column:
    """array<struct<type, text, coords>>; null if a character belongs to no token or an atom hasn't three coordinates."""
    found = _tokens(s, ENRICHED)
    items = F.transform(found, lambda t: F.struct(F.when(t.startswith("["), "atom_with_coords").otherwise("nonatom").alias("type"), F.regexp_extract(t, r"^([^<]*)", 1).alias("text"), F.when(t.startswith("["), parse_coords(t)).alias("coords")))
    whole = (F.length(F.array_join(found, "")) == F.length(s)) & F.forall(items, lambda x: (x["type"] == "nonatom") | x["coords"].isNotNull())
    return F.when(whole, items)


def normalize_descriptor(d: Column) -> Column:
    """[CHn] and [cHn] as [C] and [c]; isotopes, charges and stereo marks stay."""
    return F.regexp_replace(d, r"^\[([Cc])H\d*\]$", "[$1]")


def expected_token(sym: Column, aromatic: Column) -> Column:
    """How an atom is written without brackets: its symbol, in small letters if it is aromatic."""
    return F.when(aromatic, F.lower(sym)).otherwise(sym)


def format_descriptor(sym: Column, hydrogens: Column, charge: Column) -> Column:
    """[symbol, hydrogens, charge] as in [NH2+]; ones are left out."""
    h = F.when(hydrogens == 0, "").when(hydrogens == 1, "H").otherwise(F.concat(F.lit("H"), hydrogens.cast("string")))
    size = F.when(F.abs(charge) == 1, "").otherwise(F.abs(charge).cast("string"))
    c = F.when(charge == 0, "").when(charge > 0, F.concat(F.lit("+"), size)).otherwise(F.concat(F.lit("-"), size))
    return F.concat(F.lit("["), sym, h, c, F.lit("]"))


def encode_enriched(atoms: Column, places: int = 4) -> Column:
    """One string of array<struct<sym, x, y, z>>, in the array's order."""
    one = lambda a: F.concat(F.lit("["), a["sym"], F.lit("]<"), F.concat_ws(",", *(truncate_fixed(a[c], places) for c in "xyz")), F.lit(">"))
    return F.array_join(F.transform(atoms, one), "")


def decode_enriched(s: Column) -> Column:
    """struct<plain, coords>: the plain string and the coordinates in order; null if the string doesn't parse, or says atoms of another number than there are coordinates."""
    tokens = tokenize_enriched(s)
    coords = F.transform(F.filter(tokens, lambda t: t["coords"].isNotNull()), lambda t: t["coords"])
    atoms = F.size(F.filter(tokens, lambda t: t["type"] == "atom_with_coords"))
    return F.when(tokens.isNotNull() & (atoms == F.size(coords)), F.struct(strip_text(s).alias("plain"), coords.alias("coords")))


def decode_loose(s: Column) -> Column:
    """array<struct<text, coords>> of all atoms with coordinates, brackets or not; whatever stands between is skipped."""
    found = _tokens(s, r"(?:\[[^\]]+\]|Cl|Br|[A-Za-z])<[^>]*>")
    return F.transform(found, lambda t: F.struct(F.regexp_extract(t, r"^([^<]*)", 1).alias("text"), parse_coords(t).alias("coords")))


def bin_edges(low: float, high: float, width: float) -> Column:
    """Lower edges from ``low`` up to, not including, ``high``."""
    import math

    n = math.ceil((high - low) / width - 1e-12)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(low) + i * F.lit(width))


def bin_index(x: Column, edges: Column) -> Column:
    """How many edges are at most x: 0 below the first. For sorted edges."""
    return F.size(F.filter(edges, lambda e: e <= x))


def bin_index_even(x: Column, low: float, width: float, n: int) -> Column:
    """The same for ``n`` even bins, by arithmetic alone."""
    return F.greatest(F.lit(0), F.least(F.lit(n), F.floor((x - low) / width).cast("int") + 1))


def bin_center(i: Column, low: float, width: float) -> Column:
    """Middle of bin ``i``; index 0 lies one width below the first edge."""
    return F.lit(low) + (i - 0.5) * F.lit(width)


def bin_draw(i: Column, low: float, width: float, seed: int, *of: Column) -> Column:
    """A seeded place within bin ``i``, even over its width: the same for the same values ``of`` (a row's key, say)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in of)))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    return F.lit(low) + (i - 1 + u) * F.lit(width)


def encode_binned(indices: Column, n_bins: int) -> Column:
    """Indices as zero-padded numbers of three digits or more, comma-joined in angle brackets."""
    width = max(3, len(str(n_bins)))
    return F.concat(F.lit("<"), F.array_join(F.transform(indices, lambda i: F.lpad(i.cast("string"), width, "0")), ","), F.lit(">"))


def decode_binned(s: Column) -> Column:
    """Indices of a binned token, rounded to whole numbers."""
    return F.transform(parse_coords(s), lambda x: F.rint(x).cast("int"))
