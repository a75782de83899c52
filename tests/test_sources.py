"""Files as they come from elsewhere: plain folders, quotes, gaps and errors."""

import io

import pytest
from pyspark.sql import functions as F

from fluxloom.functions import text
from fluxloom.operators import grids
from fluxloom.sources import flux_csv, heads, sbml, tables


def cells(df):
    return {(r.file_name, r.label, r.sample_n, r.reaction): r.flux for r in df.collect()}


def test_plain_folder_of_wide_files(spark, tmp_path):
    (tmp_path / "liver cells+x_10k(3).csv").write_text(',"a,b",R1\n0,1.5,2\n1,,4e2\n\n')
    (tmp_path / "b_100.csv").write_text("Unnamed: 0,R1,R2\n0,7,-1\n")
    (tmp_path / "notes.txt").write_text("no data")
    assert cells(flux_csv.read(spark, str(tmp_path))) == {
        ("liver cells+x_10k(3)", "liver cells+x", 0, "a,b"): 1.5, ("liver cells+x_10k(3)", "liver cells+x", 0, "R1"): 2.0,
        ("liver cells+x_10k(3)", "liver cells+x", 1, "a,b"): 0.0,  # an empty cell
        ("liver cells+x_10k(3)", "liver cells+x", 1, "R1"): 400.0,
        ("b_100", "b", 0, "R1"): 7.0, ("b_100", "b", 0, "R2"): -1.0,
    }
    one = flux_csv.read(spark, str(tmp_path / "b_100.csv"))
    assert {r.file_name for r in one.collect()} == {"b_100"}
    assert {r.file_name for r in flux_csv.discover(spark, str(tmp_path)).collect()} == {"liver cells+x_10k(3)", "b_100"}
    union = {r.reaction: r.n_files for r in flux_csv.header_union(spark, str(tmp_path)).collect()}
    assert union == {"a,b": 1, "R1": 2, "R2": 1}


class Counted(io.BytesIO):
    taken = 0

    def read(self, size=-1):
        found = super().read(size)
        self.taken += len(found)
        return found


def test_heads_read_the_first_bytes_only(spark, tmp_path):
    body = b",a,b\r\n0,1,2\r\n\n1,3,4\r5,5,6\n  \n" + b"6,7,8\n" * 200_000
    for first_read in (1, 2, 3, 7, 64):
        for n, lines in ((1, [",a,b"]), (3, [",a,b", "0,1,2", "1,3,4"]), (5, [",a,b", "0,1,2", "1,3,4", "5,5,6", "6,7,8"])):
            stream = Counted(body)
            assert heads.top(stream, n, first_read) == lines and stream.taken < 300
    stream = Counted(body)
    assert heads.top(stream, 2) == [",a,b", "0,1,2"] and stream.taken == heads.FIRST_READ < len(body) / 10
    assert heads.top(Counted(b""), 3) == [] and heads.top(Counted(b"\n \n"), 3) == []
    assert heads.top(Counted("\ufeffi,é".encode()), 3) == ["i,é"]
    (tmp_path / "a b+c_1.csv").write_bytes(body)
    (tmp_path / "x_1.csv").write_text('i,"q,r"\n')
    (tmp_path / "y_1.csv").write_text("")
    found = heads.first_lines(spark, f"{tmp_path}/*.csv", 300).collect()
    assert len(found) == 301 and {r.value for r in found if r.at == 299} == {"6,7,8"}
    with_text = {r.path: r.value for r in flux_csv.read_lines(spark, str(tmp_path)).filter("value like 'i,%'").collect()}
    assert with_text == {r.path: r.value for r in found if r.value.startswith("i,")}
    assert cells(flux_csv.read_head(spark, str(tmp_path), 2)) == {
        ("a b+c_1", "a b+c", 0, "a"): 1.0, ("a b+c_1", "a b+c", 0, "b"): 2.0,
        ("a b+c_1", "a b+c", 1, "a"): 3.0, ("a b+c_1", "a b+c", 1, "b"): 4.0}


def test_folder_without_csv_is_an_error(spark, tmp_path):
    for fn in (flux_csv.read, flux_csv.discover, flux_csv.header_union):
        with pytest.raises(FileNotFoundError):
            fn(spark, str(tmp_path))


def test_text_in_a_cell_is_an_error(spark, tmp_path):
    (tmp_path / "a_1.csv").write_text(",R1\n0,abc\n")
    with pytest.raises(Exception, match="abc"):
        flux_csv.read(spark, str(tmp_path)).collect()


def test_names_with_quotes_and_commas_survive(spark, tmp_path):
    flux = spark.createDataFrame([("m_1", "m", s, r, float(s)) for s in range(5) for r in ('say "hi", you', "plain")],
                                 "file_name string, label string, sample_n bigint, reaction string, flux double")
    flux_csv.write(flux, str(tmp_path / "out"), rows_per_part=2)
    assert cells(flux_csv.read(spark, str(tmp_path / "out"))) == cells(flux)


SBML = """<?xml version="1.0" encoding="UTF-8"?>
<sbml xmlns="http://www.sbml.org/sbml/level3/version1/core" xmlns:fbc="http://www.sbml.org/sbml/level3/version1/fbc/version2">
<model id="m"><listOfSpecies>
<species id="M1" name="water" compartment="c" fbc:charge="0" fbc:chemicalFormula="H2O"/>
<species id="M2" name="x, y" compartment="e" fbc:charge="-1" fbc:chemicalFormula="CO"/>
</listOfSpecies><listOfReactions>
<reaction id="R1"><listOfReactants><speciesReference species="M1" stoichiometry="2"/></listOfReactants>
<listOfProducts><speciesReference species="M2" stoichiometry="1"/><speciesReference species="M1" stoichiometry="0.5"/></listOfProducts></reaction>
<reaction id="R2"><listOfProducts><speciesReference species="M2"/></listOfProducts></reaction>
</listOfReactions></model></sbml>"""


def test_sbml_with_one_or_many_references(spark, tmp_path):
    (tmp_path / "liver.xml").write_text(SBML)
    found = sbml.read_coefficients(spark, str(tmp_path))
    assert {(r.model, r.reaction_id, r.metabolite, r.stoich) for r in found.collect()} == {
        ("liver", "R1", "M1", -1.5), ("liver", "R1", "M2", 1.0), ("liver", "R2", "M2", 1.0)}
    names = {r.reaction_id: r.reaction for r in
             sbml.canonical_names(found, sbml.read_species(spark, str(tmp_path))).collect()}
    assert names["R2"] == "r[m[n[x. y]f[CO]ch[-1]co[e]]s[1.0]]"
    assert names["R1"] == "r[m[n[water]f[H2O]ch[0]co[c]]s[-1.5]m[n[x. y]f[CO]ch[-1]co[e]]s[1.0]]"


def test_model_names(spark):
    names = {"liver_10k(3)": "liver", "a_b_100": "a_b", "plain": "plain", "x_k": "x", "x_10k()": "x", "x_1(a)": "x_1(a)"}
    df = spark.createDataFrame([(n,) for n in names], "f string")
    assert {r.f: r.m for r in df.select("f", text.model_name(F.col("f")).alias("m")).collect()} == names


def test_booleans(spark):
    df = spark.createDataFrame([("TRUE",), ("false",)], "t string")
    assert [r.b for r in df.select(text.parse_boolean(F.col("t")).alias("b")).collect()] == [True, False]
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("yes",)], "t string").select(text.parse_boolean(F.col("t"))).collect()


def test_missing_arguments_take_defaults(spark, tmp_path):
    for run, body in ((0, '{\n "run": 0,\n "lr": 0.1\n}'), (1, '{"run": 1, "n_emb": 4}')):
        (tmp_path / str(run)).mkdir()
        (tmp_path / str(run) / "args.json").write_text(body)
    found = tables.read_run_args(spark, str(tmp_path), "run bigint, lr double, n_emb bigint", {"n_emb": 128})
    assert {(r.run, r.lr, r.n_emb) for r in found.collect()} == {(0, 0.1, 128), (1, None, 4)}


def test_grid_order_and_command_line(spark):
    grid = grids.param_grid(spark, {"lr": [0.1, 0.2], "n": [1, 2, 3]})
    rows = sorted(grid.collect())
    assert [(r.run, r.lr, r.n) for r in rows] == [(0, .1, 1), (1, .1, 2), (2, .1, 3), (3, .2, 1), (4, .2, 2), (5, .2, 3)]
    line = grids.command_line(grid, {"lr": "float", "n": "int"}).filter("run = 0").first()
    assert line.arg_str == "--lr 1.0000e-01 -n 1"


def cells_of(spark, folder, text):
    (folder / "a_1.csv").write_text(text)
    return {(r.sample_n, r.reaction): r.flux for r in flux_csv.read(spark, str(folder)).collect()}


def test_header_is_the_first_line_whatever_the_index_looks_like(spark, tmp_path):
    for at, (text, rows) in enumerate((
            (",x,y\n0.0,1,2\n1.0,3,4\n", (0, 1)), (',x,y\n"0",1,2\n"1",3,4\n', (0, 1)), ("i,x,y\n0,1,2\n1,3,4\n", (0, 1)))):
        folder = tmp_path / str(at)
        folder.mkdir()
        assert cells_of(spark, folder, text) == {
            (rows[0], "x"): 1.0, (rows[0], "y"): 2.0, (rows[1], "x"): 3.0, (rows[1], "y"): 4.0}
    (tmp_path / "named").mkdir()
    named = cells_of(spark, tmp_path / "named", ",x\nfirst,1\nsecond,2\n")
    assert sorted(named.values()) == [1.0, 2.0] and len({n for n, _ in named}) == 2


@pytest.mark.parametrize("line", ["1,3,4,5", "1,3"])
def test_ragged_lines_are_errors(spark, tmp_path, line):
    with pytest.raises(Exception, match="not as many cells"):
        cells_of(spark, tmp_path, f",x,y\n0,1,2\n{line}\n")


def test_species_without_formula_or_charge_keep_their_names(spark):
    species = spark.createDataFrame([("m", "A", "a", None, None, "c"), ("m", "B", "b", None, None, "c"), ("m", "C", "c", "C1", 0, "c")],
                                    "model string, metabolite string, name string, formula string, charge bigint, compartment string")
    species = species.withColumn("metabolite_name", text.metabolite_name(*map(F.col, ("name", "formula", "charge", "compartment"))))
    entries = spark.createDataFrame([("m", "r1", "A", -1.0), ("m", "r1", "C", 1.0), ("m", "r2", "B", -1.0), ("m", "r2", "C", 1.0)],
                                    "model string, reaction_id string, metabolite string, stoich double")
    reactions = spark.createDataFrame([("m", "r1"), ("m", "r2"), ("m", "r3")], "model string, reaction_id string")
    names = {r.reaction_id: r.reaction for r in sbml.canonical_names(entries, species, reactions).collect()}
    assert len(set(names.values())) == 3 and names["r3"] == "r[]" and "f[None]ch[None]" in names["r1"]
    strange = entries.union(spark.createDataFrame([("m", "r4", "?", 1.0)], entries.schema))
    with pytest.raises(Exception, match="unknown species"):
        sbml.canonical_names(strange, species).collect()


def test_run_folders_are_read(spark, tmp_path):
    for run, lines in (("a b", ["loss,test_loss", "3.0,4.0", "2.0,"]), ("c", ["test_loss,other,loss", "1,9,5"]), ("d", [])):
        (tmp_path / run).mkdir()
        if lines:
            (tmp_path / run / "losses.csv").write_text("\n".join(lines) + "\n")
    found = tables.read_run_logs(spark, str(tmp_path), ["loss", "test_loss", "epoch"])
    assert sorted(map(tuple, found.collect())) == [
        ("a b", 0, 3.0, 4.0, None), ("a b", 1, 2.0, None, None), ("c", 0, 5.0, 1.0, None)]
    args = spark.createDataFrame([("c",), ("d",)], "run string")
    assert sorted(map(tuple, tables.unreadable_runs(found, args).collect())) == [("a b", "arguments"), ("d", "log")]


def test_stage_tables_as_csv(spark, tmp_path):
    view = spark.createDataFrame([("f", 0, [1.5, -2.0]), ("g", 1, [0.0, 3.0])], "file_name string, sample_n bigint, v array<double>")
    tables.write_stage(view.coalesce(1), str(tmp_path / "out"), ["emb0", "a,b"], ["file_name", "sample_n"])
    read = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out"))
    assert read.columns == ["file_name", "sample_n", "emb0", "a,b"]
    assert sorted(map(tuple, read.collect())) == [("f", 0, 1.5, -2.0), ("g", 1, 0.0, 3.0)]
