"""Logs in both layouts, and atoms with alternatives."""

from __future__ import annotations

import pytest

from assaylane.operators import superposition
from assaylane.sources import text


def test_flat_logs(spark, tmp_path):
    for allele, name, body in (("A0201", "PEP_RUN.log", "x template 1ABC y"), ("A0202", "PEP_RUN.log", "template 2XYZ"), ("A0201", "OTHER_RUN.log", "nothing"), ("A0201", "PEP.txt", "template 9ZZZ")):
        (tmp_path / allele).mkdir(exist_ok=True)
        (tmp_path / allele / name).write_text(body)
    found = text.scan_logs(spark, str(tmp_path), r"template (\w+)", suffix="_RUN.log")
    assert {tuple(r) for r in found.collect()} == {("A0201", "PEP", "1ABC"), ("A0202", "PEP", "2XYZ")}


@pytest.mark.parametrize("flat", [True, False])
def test_two_logs_of_a_pair_are_an_error(spark, tmp_path, flat):
    for i in "12":
        folder = tmp_path / i / "A0201" if flat else tmp_path / "A0201" / "PEP"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / ("PEP_RUN.log" if flat else f"run{i}.log")).write_text("template 1ABC")
    with pytest.raises(ValueError, match="several logs"):
        text.scan_logs(spark, str(tmp_path) if flat else str(tmp_path / "A0201/PEP"), r"template (\w+)", suffix="_RUN.log" if flat else None)


def atom(record, serial, name, altloc, resname, chain, number, x):
    return f"{record:<6}{serial:>5} {name:<4}{altloc:1}{resname:>3} {chain}{number:>4}    {x:8.3f}{0:8.3f}{0:8.3f}"


def test_atoms_with_alternatives(spark, tmp_path):
    residues = ["ALA", "CYS", "ASP", "GLU", "PHE"]
    lines = [atom("ATOM", i, " CA", "", r, "A", i, float(i)) for i, r in enumerate(residues)]
    lines.insert(1, atom("ATOM", 90, " CA", "B", "ALA", "A", 0, 50.0))
    lines += [atom("HETATM", 99, " O", "", "HOH", "A", 99, 9.0), atom("HETATM", 98, " CA", "", "GLY", "A", 98, 8.0), "REMARK ATOM"]
    (tmp_path / "m.pdb").write_text("\n".join(lines) + "\n")
    atoms = text.read_atoms(spark, str(tmp_path / "m.pdb"))
    assert atoms.count() == 6 and {r.altloc for r in atoms.collect()} == {"", "B"}
    chain = superposition.chain_table(atoms, ["path"]).first()
    assert chain.sequence == "ACDEF" and chain.ca[:3] == [0.0, 0.0, 0.0]
    both = text.read_atoms(spark, str(tmp_path / "m.pdb"), records=("ATOM", "HETATM"))
    assert both.count() == 8 and superposition.chain_table(both, ["path"]).first().sequence == "ACDEFG"
