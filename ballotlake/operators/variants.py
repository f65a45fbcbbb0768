"""Problem 4: nested records of varying shape into flat typed tables with parent links.

A bottom-up tree automaton gives every node of a JSON document a state from its fields and the states of its children; the
state of an object is the first rule it satisfies, so optional, nil, wrapped or listed fields don't matter, and neither does the name under which a
shape hangs. A second walk, top-down, routes each node to the typed table of its state and links it to the parent it was found under. Both walks
keep their own stack: no depth is too deep.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from json.decoder import scanstring
from json.scanner import NUMBER_RE

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import key, trimmed

NIL, VALUE, FLAT, OBJECT = "nil", "valeur", "plat", "objet"
ANY = "*"

#: Fixed values of the source format: the transitions, first match wins. (state, fields it must have with the states
#: they may be in; () for any state; the field * stands for any field). A list has the state of its most telling item.
RULES = (
    ("scrutin", {"uid": (VALUE,), ANY: ("synthese", "ventilation")}),
    ("scrutin", {"uid": (VALUE,), "syntheseVote": ()}),
    ("scrutin", {"uid": (VALUE,), "ventilationVotes": ()}),
    ("amendement", {"uid": (VALUE,), ANY: ("signataires",)}),
    ("amendement", {"uid": (VALUE,), "signataires": ()}),
    ("organe", {"uid": (VALUE,), "codeType": (VALUE, NIL)}),
    ("document", {"uid": (VALUE,)}),
    ("groupe", {"organeRef": (VALUE,), "vote": ()}),
    ("auteur", {"acteurRef": (VALUE, NIL), "auteurRapporteurOrganeRef": (VALUE, NIL)}),
    ("auteur", {"acteurRef": (VALUE, NIL), "typeAuteur": (VALUE, NIL)}),
    ("personne", {"acteurRef": (VALUE, NIL)}),
    ("signataires", {"auteur": ("personne",)}),
    ("signataires", {ANY: ("auteur",)}),
    ("nominatif", {"pours": ("liste", "personne")}),
    ("nominatif", {"contres": ("liste", "personne")}),
    ("nominatif", {"abstentions": ("liste", "personne")}),
    ("nominatif", {"nonVotants": ("liste", "personne")}),
    ("liste", {ANY: ("personne",)}),
    ("synthese", {"nombreVotants": (VALUE, NIL)}),
    ("synthese", {"suffragesExprimes": (VALUE, NIL)}),
    ("synthese", {"nbrSuffragesRequis": (VALUE, NIL)}),
    ("synthese", {"decompte": (FLAT, OBJECT)}),
    ("ventilation", {ANY: ("groupes",)}),
    ("ventilation", {ANY: ("ventilation",)}),
    ("groupes", {ANY: ("groupe",)}),
)
LISTS = ("pours", "contres", "abstentions", "nonVotants")
TOTALS = ("nombreVotants", "suffragesExprimes", "nbrSuffragesRequis")
#: States below which there is nothing that a rule names.
LEAVES = (FLAT,)
RECORDS = ("scrutin", "amendement", "organe", "document")
#: The typed table of each subtype: its own columns beside the supertype's keys and parent link.
TABLES = {
    "scrutin": (), "amendement": (), "document": (), "organe": ("code_type",), "synthese": ("comptes",), "groupe": ("organe_ref", "position_majoritaire"),
    "votant": ("liste", "acteur_ref", "mandat_ref", "par_delegation", "cause"), "auteur": ("acteur_ref", "type_auteur", "rapporteur_organe_ref"),
}


def scalar(x: object) -> str | None:
    """The text of a value: ``#text`` is unwrapped; nil and empty are None."""
    while isinstance(x, dict):
        if str(x.get("@xsi:nil", "")).strip().lower() == "true":
            return None
        x = x.get("#text")
    if x is None or isinstance(x, list):
        return None
    if isinstance(x, bool):
        return "true" if x else "false"
    return str(x).strip() or None


def whole(text: str | None) -> float | None:
    """The number a text is, if it is a whole one."""
    try:
        return int(text) if text is not None and -(1 << 63) <= int(text) < 1 << 63 else None
    except ValueError:
        return None


def many(x: object) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


_WORDS = {"null": None, "true": True, "false": False, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def deep_loads(s: str) -> object:
    """What ``json.loads`` gives, by an explicit stack instead of recursion, so that any depth is read. ValueError if ``s`` is not whole JSON."""

    def skip(i: int) -> int:
        while i < len(s) and s[i] in " \t\n\r":
            i += 1
        return i

    def fail():
        raise ValueError("not whole JSON")

    stack: list[tuple[list | dict, str | None]] = []
    i, out, more = skip(0), None, True
    while True:
        if more:  # a value begins at i
            if stack and isinstance(stack[-1][0], dict):
                if s[i : i + 1] != '"':
                    fail()
                name, i = scanstring(s, i + 1)
                i = skip(i)
                if s[i : i + 1] != ":":
                    fail()
                stack[-1] = (stack[-1][0], name)
                i = skip(i + 1)
            c = s[i : i + 1]
            if c and c in "{[":
                new: list | dict = {} if c == "{" else []
                i = skip(i + 1)
                if s[i : i + 1] != ("}" if c == "{" else "]"):
                    stack.append((new, None))
                    continue
                out, i = new, i + 1
            elif c == '"':
                out, i = scanstring(s, i + 1)
            else:
                word = next((w for w in _WORDS if s.startswith(w, i)), None)
                m = None if word else NUMBER_RE.match(s, i)
                if word:
                    out, i = _WORDS[word], i + len(word)
                elif m:
                    whole_part, frac, exp = m.groups()
                    out, i = (float(m.group()) if frac or exp else int(whole_part)), m.end()
                else:
                    fail()
        i = skip(i)
        if not stack:
            return out if i == len(s) else fail()
        holder, name = stack[-1]
        if isinstance(holder, dict):
            holder[name] = out
        else:
            holder.append(out)
        c = s[i : i + 1]
        if c == ",":
            i, more = skip(i + 1), True
        elif c == ("}" if isinstance(holder, dict) else "]"):
            out, i, more = stack.pop()[0], i + 1, False
        else:
            fail()


def loads(s: str) -> object:
    try:
        return json.loads(s)
    except RecursionError:
        return deep_loads(s)


_TELLING = {NIL: 0, VALUE: 1, FLAT: 2, OBJECT: 2}


_NIL, _VALUE = (NIL, NIL), (VALUE, VALUE)


class Automaton:
    """The run of the automaton over documents. What follows from the fields of an object and their states is found once and kept; shapes (states with the states below) are kept as digests."""

    def __init__(self, rules=RULES):
        self.rules, self.known = rules, {}

    def _state(self, fields: dict[str, str]) -> str:
        values = set(fields.values())
        for state, need in self.rules:
            for name, of in need.items():
                if name == ANY:
                    if values.isdisjoint(of):
                        break
                elif name not in fields or (of and fields[name] not in of):
                    break
            else:
                return state
        return FLAT if fields and values <= {VALUE, NIL} else OBJECT

    def _of_object(self, fields: tuple) -> tuple[str, str]:
        """State and shape of an object of ``fields``: (name, (state, shape)) in any order."""
        got = self.known.get(fields)
        if got is None:
            below = sorted(fields)
            state = self._state({k: s for k, (s, _) in below})
            got = self._keep(fields, state, (state, *((k, shape) for k, (_, shape) in below)))
        return got

    def _of_list(self, items: frozenset) -> tuple[str, str]:
        got = self.known.get(items)
        if got is None:
            below = sorted(items)
            state = max((s for s, _ in below), key=lambda s: _TELLING.get(s, 3), default=NIL)
            got = self._keep(items, state, ("[", *(shape for _, shape in below)))
        return got

    def _keep(self, key, state: str, parts: tuple) -> tuple[str, str]:
        if len(self.known) > 100_000:
            self.known.clear()
        self.known[key] = got = (state, hashlib.blake2b(repr(parts).encode(), digest_size=8).hexdigest())
        return got

    def run(self, doc: object) -> dict[int, tuple[str, str]]:
        """State and shape of each object and list by identity."""
        of: dict[int, tuple[str, str]] = {}
        order, stack = [], [doc] if isinstance(doc, (dict, list)) else []
        while stack:  # parents before children
            x = stack.pop()
            if type(x) is dict and ("#text" in x or "@xsi:nil" in x):
                of[id(x)] = _NIL if scalar(x) is None else _VALUE
                continue
            order.append(x)
            stack.extend([y for y in (x if type(x) is list else x.values()) if type(y) is dict or type(y) is list])
        for x in reversed(order):
            if type(x) is list:
                of[id(x)] = self._of_list(frozenset([of[id(y)] if type(y) is dict or type(y) is list else _NIL if y is None else _VALUE for y in x]))
            else:
                of[id(x)] = self._of_object(tuple([(k, of[id(v)] if type(v) is dict or type(v) is list else _NIL if v is None else _VALUE) for k, v in x.items() if k[:1] != "@"]))
        return of

    def rows(self, doc: object) -> tuple[str, list[tuple[str | None, int, int, str, dict]]]:
        """The variant and the nodes (uid of the record, node, parent node, subtype, fields). A node goes where its state says."""
        of = self.run(doc)
        shape = of[id(doc)][1] if id(doc) in of else VALUE
        out: list = []
        stack: list[tuple[object, str | None, int, str, str | None]] = [(doc, None, 0, "", None)]
        while stack:
            x, uid, parent, above, kind = stack.pop()
            if isinstance(x, list):
                stack.extend((y, uid, parent, above, kind) for y in reversed(x) if isinstance(y, (dict, list)))
                continue
            if not isinstance(x, dict):
                continue
            state = of[id(x)][0]
            if state in (NIL, VALUE):
                continue
            subtype, fields = state, None
            if state in RECORDS:
                uid, fields = scalar(x["uid"]), {"code_type": scalar(x["codeType"])} if state == "organe" else {}
            elif state == "groupe":
                held = [scalar(v.get("positionMajoritaire")) for v in many(x["vote"]) if isinstance(v, dict)]
                fields = {"organe_ref": scalar(x["organeRef"]), "position_majoritaire": next((h for h in held if h), None)}
            elif state == "synthese":
                counts = {k: scalar(x.get(k)) for k in TOTALS}
                for d in many(x.get("decompte")):
                    if isinstance(d, dict) and of[id(d)][0] not in (NIL, VALUE):
                        counts |= {k: scalar(v) for k, v in d.items() if not k.startswith(("@", "#"))}
                fields = {"comptes": [{"champ": k, "texte": v, "nombre": whole(v)} for k, v in counts.items() if v is not None]}
            elif kind is not None and state in ("personne", "auteur"):
                subtype, said = "votant", scalar(x.get("parDelegation"))
                fields = {"liste": kind, "acteur_ref": scalar(x["acteurRef"]), "mandat_ref": scalar(x.get("mandatRef")), "par_delegation": said == "true" if said else None, "cause": scalar(x.get("causePositionVote"))}
            elif state == "auteur" or (state == "personne" and above == "auteur"):
                subtype = "auteur"
                fields = {"acteur_ref": scalar(x["acteurRef"]), "type_auteur": scalar(x.get("typeAuteur")), "rapporteur_organe_ref": scalar(x.get("auteurRapporteurOrganeRef"))}
            if fields is not None:
                out.append((uid, len(out) + 1, parent, subtype, fields))
                parent = len(out)
            if state in LEAVES:
                continue
            for k, v in reversed(list(x.items())):
                if type(v) is dict or type(v) is list:
                    stack.append((v, uid, parent, k if state == "signataires" else "", k if state == "nominatif" and k in LISTS else kind if state == "liste" else None))
        return shape, out


_KEYS = "record string, uid string, variante string, noeud bigint, noeud_parent bigint, sous_type string"
_OWN = {
    "code_type": "string", "comptes": "array<struct<champ:string,texte:string,nombre:bigint>>", "organe_ref": "string", "position_majoritaire": "string", "liste": "string", "acteur_ref": "string",
    "mandat_ref": "string", "par_delegation": "boolean", "cause": "string", "type_auteur": "string", "rapporteur_organe_ref": "string",
}
NODES = ", ".join([_KEYS, *(f"{c} {t}" for c, t in _OWN.items())])
_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "comptes": pa.list_(pa.struct([("champ", pa.string()), ("texte", pa.string()), ("nombre", pa.int64())]))}


def classify(df: DataFrame, record: str, content: str) -> DataFrame:
    """The nodes of every whole JSON document: supertype keys (``record`` as text, ``uid``), parent link, subtype, and the typed columns of all subtypes.

    Null, empty and cut-off documents give no row; repeated ones repeat theirs; other columns are ignored. However deep a document is nested, it is read. Runs
    in Arrow batches; documents are spread evenly first, however the files are cut, and equal ones of a batch are walked once.
    """
    names = ["record", "uid", "variante", "noeud", "noeud_parent", "sous_type", *_OWN]
    types = [pa.string()] * 3 + [pa.int64()] * 2 + [pa.string()] + [_ARROW.get(c) or _ARROW[t] for c, t in _OWN.items()]
    schema = pa.schema(list(zip(names, types)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            seen: dict[str, tuple] = {}
            cols: dict[str, list] = {c: [] for c in names}
            for record_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text not in seen:
                    try:
                        seen[text] = automaton.rows(loads(text))
                    except ValueError:
                        seen[text] = ("", [])
                variant, nodes = seen[text]
                for uid, n, parent, kind, fields in nodes:
                    for c, v in zip(names, (record_id, uid, variant, n, parent, kind)):
                        cols[c].append(v)
                    for c in _OWN:
                        cols[c].append(fields.get(c))
                if len(cols["record"]) > 50_000:
                    yield pa.RecordBatch.from_pydict(cols, schema)
                    cols = {c: [] for c in names}
            yield pa.RecordBatch.from_pydict(cols, schema)

    src = df.where(F.col(content).isNotNull()).select(F.col(record).cast("string").alias("record"), F.col(content).alias("content"))
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return src.repartition(tasks, F.xxhash64("record", "content")).mapInArrow(walk, NODES)


def typed(nodes: DataFrame, subtype: str) -> DataFrame:
    """The typed table of one subtype: supertype keys, parent link and its own columns. Of nodes written by ``sous_type`` it reads its own files and columns only."""
    return nodes.where(F.col("sous_type") == subtype).select("record", key("uid").alias("uid"), "variante", "noeud", "noeud_parent", *TABLES[subtype])


def links(nodes: DataFrame) -> DataFrame:
    """All typed tables as rows (genre, parent, enfant, valeur), distinct; rows without one of the last three are left out."""

    def part(genre: str, table: DataFrame, child, value) -> DataFrame:
        return table.select(F.lit(genre).alias("genre"), F.col("uid").alias("parent"), child.alias("enfant"), value.alias("valeur"))

    counts = typed(nodes, "synthese").select("uid", F.explode("comptes").alias("c"))
    parts = [
        part("synthese", counts, F.col("c.champ"), F.col("c.texte")), part("groupe", typed(nodes, "groupe"), key("organe_ref"), F.col("position_majoritaire")),
        part("votant", typed(nodes, "votant"), key("acteur_ref"), F.col("liste")), part("organe", typed(nodes, "organe"), F.lit("codeType"), F.col("code_type")),
        part("rapporteur", typed(nodes, "auteur"), key("acteur_ref"), key("rapporteur_organe_ref")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("parent").isNotNull() & F.col("enfant").isNotNull() & trimmed("valeur").isNotNull()).distinct()
