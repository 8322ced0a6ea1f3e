"""A seeded generator of register files of our own, with the defects that registers have and the truth about them.

Names are drawn from syllables, so any size can be made. Written by plain Python on the driver: it is a source of test
data, not an operator."""

from __future__ import annotations

import csv
import json
import random
from pathlib import Path

LEGAL = {"GB": ["Ltd", "Limited", "LTD."], "NL": ["B.V.", "BV"], "VG": ["IBC", "Ltd."], "CY": ["Limited", "Ltd"], "US": ["Inc", "Inc.", "Incorporated"]}
_SYLLABLES = "ka ro mi le na ve tor bel sun dra fi os tan gor lin pe ral mo zet ur".split()
#: Other spellings of a sound, as romanisations differ.
_VARIANTS = [("v", "w"), ("i", "y"), ("k", "c")]


def _word(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(n)).capitalize()


def _typo(rng: random.Random, name: str) -> str:
    at = rng.randrange(1, len(name) - 1)
    return name[:at] + name[at + 1] + name[at] + name[at + 2 :]


def _person_variant(rng: random.Random, name: str) -> str:
    a, b = rng.choice(_VARIANTS)
    return rng.choice([name, name.upper(), name.replace(a, b), name])


def _company_variant(rng: random.Random, stem: str, jurisdiction: str) -> str:
    name = f"{stem} {rng.choice(LEGAL[jurisdiction])}"
    return rng.choice([name, name.upper(), _typo(rng, stem) + name[len(stem) :], name])


def generate(folder: str, people: int = 30, companies: int = 40, seed: int = 1) -> dict[str, list[str]]:
    """Writes all nine files; returns for each true entity the ids of its records."""
    rng = random.Random(seed)
    top = Path(folder)
    top.mkdir(parents=True, exist_ok=True)
    truth: dict[str, list[str]] = {}
    rows: dict[str, list] = {k: [] for k in ("lei", "l2", "ch", "ofac", "nodes", "links", "agg")}
    ftm, filings = [], []
    who, what = [], []
    for i in range(people):
        name = f"{_word(rng, 2)} {_word(rng, 3)}"
        born, nation = f"{rng.randrange(1940, 1990)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", rng.choice(["RU", "NL", "GB", "US"])
        key = f"P{i:03d}"
        who.append((key, name, born, nation))
        truth[key] = []
        for k in range(rng.randrange(1, 3)):
            truth[key].append(f"agg-{key}-{k}")
            rows["agg"].append((f"agg-{key}-{k}", "person", _person_variant(rng, name), nation, "", born[: rng.choice([4, 10])], "register"))
        if rng.random() < 0.3:
            truth[key].append(f"os-{key}")
            ftm.append({"id": f"os-{key}", "schema": "Person", "properties": {"name": [name], "birthDate": [born], "nationality": [nation.lower()], "topics": ["role.pep"]}})
        if rng.random() < 0.2:
            truth[key].append(f"ofac-{i}")
            first, last = name.split(" ")
            rows["ofac"].append((str(i), f"{last.upper()}, {first.upper()}", "individual", "PROGRAM", nation, born, ""))
    for i in range(companies):
        stem, where = f"{_word(rng, 3)} {_word(rng, 2)}", rng.choice(sorted(LEGAL))
        key, lei, number = f"C{i:03d}", f"LEI{i:017d}", f"{i:08d}"
        address = f"{rng.randrange(1, 90)} {_word(rng, 3)} Street, {_word(rng, 2)}"
        what.append((key, stem, where, lei))
        truth[key] = [f"lei-{lei}"]
        rows["lei"].append((lei, f"{stem} {LEGAL[where][0]}", where, LEGAL[where][0], address, "ACTIVE", "2011-01-01"))
        if rng.random() < 0.6:
            truth[key].append(f"ch-{number}")
            rows["ch"].append((number, _company_variant(rng, stem, where), "active", where, "2011-01-01", address.upper(), "70100"))
        if rng.random() < 0.6:
            truth[key].append(f"agg-{key}-0")
            rows["agg"].append((f"agg-{key}-0", "company", _company_variant(rng, stem, where), where, address, "", "register"))
        if i and rng.random() < 0.4:
            parent = rng.choice(what[:-1])
            rows["l2"].append((lei, parent[3], "IS_DIRECTLY_CONSOLIDATED_BY", "ACTIVE", rng.choice(["FULLY_CORROBORATED", "PARTIALLY_CORROBORATED"])))
        owner = rng.choice(who)
        if rng.random() < 0.5:
            subject, party = f"psc-ent-{key}", f"psc-int-{owner[0]}-{key}"
            truth[key].append(subject)
            truth[owner[0]].append(party)
            filings.append({"statementID": f"oo-{i}", "subject": {"describedByEntityStatement": subject, "name": _company_variant(rng, stem, where), "jurisdiction": where}, "interestedParty": {"describedByPersonStatement": party, "type": "individual", "name": owner[1], "birthDate": owner[2][:7], "nationality": owner[3], "address": {"full": ""}}, "interests": [{"type": "shareholding", "share": {"exact": float(rng.randrange(25, 101))}, "startDate": "2012-01-01"}], "source": {"retrievedAt": "2024-01-01"}})
        elif rng.random() < 0.5:
            truth[key].append(f"icij-{key}")
            truth[owner[0]].append(f"icij-{owner[0]}-{key}")
            rows["nodes"] += [(f"icij-{key}", _company_variant(rng, stem, where), "entity", where, address, "Leak"), (f"icij-{owner[0]}-{key}", owner[1], "officer", owner[3], "", "Leak")]
            rows["links"].append((f"icij-{owner[0]}-{key}", f"icij-{key}", "shareholder_of", f"shareholder of ({rng.randrange(10, 101)}%)", "", "Leak"))
    heads = {
        "lei": ("gleif_level1.csv", ["LEI", "Entity.LegalName", "Entity.LegalJurisdiction", "Entity.LegalForm", "Entity.LegalAddress", "Entity.EntityStatus", "Registration.InitialRegistrationDate"]),
        "l2": ("gleif_level2.csv", ["Relationship.StartNode.NodeID", "Relationship.EndNode.NodeID", "Relationship.RelationshipType", "Relationship.Status", "Registration.ValidationSources"]),
        "ch": ("companies_house.csv", ["company_number", "company_name", "company_status", "jurisdiction", "date_of_creation", "registered_office_address", "sic_code"]),
        "ofac": ("ofac_sdn.csv", ["ent_num", "SDN_Name", "SDN_Type", "Program", "Nationality", "DOB", "Remarks"]),
        "nodes": ("icij_offshore_nodes.csv", ["node_id", "name", "node_type", "jurisdiction_description", "address", "sourceID"]),
        "links": ("icij_offshore_edges.csv", ["node_id_start", "node_id_end", "rel_type", "link", "start_date", "sourceID"]),
        "agg": ("aggregator_extract.csv", ["record_id", "entity_type", "name", "jurisdiction", "address", "birth_date", "source_register"]),
    }
    for key, (name, head) in heads.items():
        with (top / name).open("w", newline="", encoding="utf-8") as out:
            csv.writer(out, lineterminator="\n").writerows([head, *rows[key]])
    (top / "opensanctions.ftm.json").write_text(json.dumps({"format": "ftm", "entities": ftm}), encoding="utf-8")
    (top / "openownership_psc.json").write_text(json.dumps({"format": "bods", "statements": filings}), encoding="utf-8")
    return truth
