"""Many small books share a table on their way out of Python; large pages still go by themselves."""

import io
import zipfile

import pandas as pd

from lectern.sources import extract


def book(pages):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in pages.items():
            z.writestr(name, body)
    return out.getvalue()


class Caught:
    """Stands for the table of books: it keeps the function that is mapped over it."""

    def select(self, *_):
        return self

    def mapInPandas(self, work, _):  # noqa: N802
        return work


def test_small_books_share_tables_and_large_pages_do_not():
    work = extract.members(Caught())
    small = pd.DataFrame({"file": [str(i) for i in range(500)], "content": [book({"a.html": f"<p>{i}</p>", "b.html": "x"}) for i in range(500)]})
    tables = list(work(iter([small, small])))
    assert len(tables) <= 3 and sum(map(len, tables)) == 2000 and max(map(len, tables)) <= extract.MEMBER_ROWS
    assert [bytes(c) for c in tables[0]["content"][:2]] == [b"<p>0</p>", b"x"]
    large = pd.DataFrame({"file": ["l"], "content": [book({f"{i}.html": b"y" * 5_000_000 for i in range(4)})]})
    assert max(sum(map(len, t["content"])) for t in work(iter([large]))) <= 13_000_000
    assert sum(map(len, work(iter([pd.DataFrame({"file": ["n", "z"], "content": [None, b"no archive"]})])))) == 0
