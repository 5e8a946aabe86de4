import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagerecs.schemas import RAW_SCHEMA  # noqa: E402
from pagerecs.session import local_session, prepare  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"

WIKIS_NOTE = "image was found in the following Wikis:"
WIKIDATA_NOTE = "image was in the Wikidata item, as its main picture"
COMMONS_NOTE = "image was found in the Commons category of the place"

MONTH, DAY = "2023-09", "2023-09-12"


def entity(name):
    return f'{{"id":"{name}"}}'


def candidate(image, rating=None, note=None):
    """A candidate map; what is None has no key."""
    given = {"image": image, "rating": rating, "note": note}
    return {k: v for k, v in given.items() if v is not None}


#: (page_id, title, candidates, instance_of, wiki): articles with and without
#: images, a surname (no article), a page never computed and a broken entity
PAGES = [
    (21, "Granite quarry", [candidate("pit.png", "3.0", COMMONS_NOTE), candidate("slab.png", "1", WIKIDATA_NOTE)],
     entity("Q820477"), "svwiki"),
    (22, "Ferry timetable", [], None, "svwiki"),
    (35, "Alder (surname)", [candidate("alder.svg", "2", WIKIS_NOTE + " nowiki, dawiki")], entity("Q101352"), "cswiki"),
    (36, "Tram depot", None, None, "cswiki"),
    (37, "Salt mill", [candidate("mill.tif", "4"), candidate("wheel.tif", "2.7", WIKIS_NOTE + " plwiki")],
     "{oops", "cswiki"),
]


@pytest.fixture(scope="session")
def spark():
    return prepare(local_session("*", shuffle_partitions=8, app="pagerecs-tests"))


@pytest.fixture(scope="session")
def raw_data(spark):
    rows = [(f"item-{page}", page, title, given, of, wiki, MONTH) for page, title, given, of, wiki in PAGES]
    return spark.createDataFrame(rows, RAW_SCHEMA).cache()


@pytest.fixture(scope="session")
def lakes(spark):
    """A bag with a repeated row and a NULL."""
    rows = [("Mere", 3.5), ("Tarn", None), ("Tarn", None), ("Loch", 9.0)]
    return spark.createDataFrame(rows, "name string, depth double").cache()


def plan_text(df, mode="formatted"):
    """Physical plan as printed by ``explain``."""
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()
