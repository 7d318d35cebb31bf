import pytest

from twinledger.operators import pairing
from twinledger.sources import lookups

TYPES = [("VREP", "daily_*.dat", 2), ("vlow", "low_*.dat", 1), ("VHASH", "h#DAY.dat", 3), ("VGONE", "gone*.dat", 4)]
#: In import order; the last ones would come first by name.
TABLES = ["VSNA", "01A*0?.v01", "b*", "X.TXT", "A#B", "A#B?", "p.q", "VREP", "VLOW", "VHASH", "s.one", "s.two", "a*"]


@pytest.mark.parametrize(
    ("name", "table"),
    [
        ("vsna", "VSNA"),  # name
        ("VSNA.dat", "VSNA"),  # stem
        ("x.csv", "X.TXT"),  # stems of both
        ("S.csv", "s.one"),  # the first of two
        ("01Axx05.V01", "01A*0?.v01"),  # pattern, whatever the case
        ("01Axx05.V01.gz", "01A*0?.v01"),  # the stem's
        ("bag.VSNA.txt", "b*"),  # a pattern comes before a word
        ("p.q.r", "p.q"),  # a stem that is the whole table
        ("a#bc", "A#B?"),  # here # is itself
        ("ayb", "a*"),
        ("01.VSNA.102", "VSNA"),  # words
        ("VSNA_20260801", "VSNA"),
        ("编码VSNA编码.txt", "VSNA"),
        ("vsnax.txt", None),
        ("daily_1.dat", "VREP"),  # report id
        ("low_1.dat", None),  # no table is called vlow
        ("h1.dat", None),  # only a # pattern fits
        ("gone1.dat", None),
        (".vsna", "VSNA"),  # a dot in front begins no extension: a word
        ("---", None),
    ],
)
def test_file_to_table(found, name, table):
    assert found.get(name) == table


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, "1", " g", "f", "4") for i, t in enumerate(TABLES)] + [(99, "VSNA", "2", "G", "f", "4"), (0, "vsnax", "1", "e", "f", "4")]
    tables = lookups.load_charset_map(spark.createDataFrame(rows, "row_no long, table_name string, col_index string, charset string, field_name string, field_length string"))
    types = spark.createDataFrame(TYPES, "report_id string, pattern string, import_order int")
    names = [m[0] for m in test_file_to_table.pytestmark[0].args[1]]
    out = pairing.file_to_table(spark.createDataFrame([(n,) for n in names], "name string"), tables, types).collect()
    assert len({r.name for r in out}) == len(out)
    return {r.name: r.table_name for r in out}


def test_tables_without_an_order(spark):
    files = spark.createDataFrame([("t.txt",), ("u",)], "name string")
    tables = spark.createDataFrame([("t.b",), ("t.a",), ("t.a",)], "table_name string")
    types = spark.createDataFrame([], "report_id string, pattern string, import_order int")
    assert [tuple(r) for r in pairing.file_to_table(files, tables, types).collect()] == [("t.txt", "t.a")]
