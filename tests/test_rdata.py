"""Serialised objects, written here by hand to the format's description."""

import gzip
import struct

from skein.sources import rdata as R


def i(*x):
    return struct.pack(f">{len(x)}i", *x)


def char(s):
    return i(9 | 1 << 18, len(s.encode())) + s.encode()


def strings(*x):
    return i(16, len(x)) + b"".join(map(char, x))


def sym(s):
    return i(1) + char(s)


def attributes(**x):
    return b"".join(i(2 | 0x400) + sym(k.replace("_", ".")) + v for k, v in x.items()) + i(254)


HEAD = b"X\n" + i(2, 0x40301, 0x20300)
FACTOR = i(13 | 0x300, 3, 1, 2, -(2**31)) + attributes(levels=strings("lo", "hi"), class_=strings("factor")).replace(char("class."), char("class"))
FRAME = i(19 | 0x300, 2) + i(14, 3) + struct.pack(">3d", 1, 2.5, 3) + FACTOR + attributes(names=strings("x", "f"), row_names=i(13, 2, -(2**31), -3), klass=strings("data.frame")).replace(char("klass"), char("class"))


def test_frame():
    ((name, v),) = R.read(gzip.compress(HEAD + FRAME))
    assert name is None and R.columns(v) == (["x", "f"], 3) and v.strings("class") == ["data.frame"]
    assert R.cells(v.data[0]) == [1.0, 2.5, 3.0] and R.cells(v.data[1]) == ["lo", "hi", None]


def test_ascii():
    ((_, v),) = R.read(b"A\n2\n262144\n131840\n16\n2\n262153\n3\na\\nb\n262153\n1\nc\n")
    assert v.data == ["a\nb", "c"]


def test_files(spark):
    rda = b"RDX2\n" + HEAD + i(2 | 0x400) + sym("d") + FRAME + i(2 | 0x400) + sym("n") + i(13, 2, 7, 8) + i(254)
    files = spark.createDataFrame([("a.rda", bytearray(rda)), ("b.rds", bytearray(b"nonsense"))], "path string, content binary")
    got = {(x.path, x.name): x for x in R.objects(files).collect()}
    assert got["a.rda", "d"].names == ["x", "f"] and got["a.rda", "d"].rows == 3 and got["a.rda", "n"].type == "integer" and got["a.rda", "n"].length == 2
    assert got["b.rds", None].error
    rows = R.frame(files.where("path = 'a.rda'"), "d").orderBy("row").collect()
    assert [x["values"] for x in rows] == [{"x": "1.0", "f": "lo"}, {"x": "2.5", "f": "hi"}, {"x": "3.0", "f": None}]
