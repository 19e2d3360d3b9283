"""Licences: linked, wrapped, prefixed and full-file forms."""

import pathlib

import pytest

from sitesift.llm import licenses

TEXTS = pathlib.Path("/usr/share/common-licenses")
FORMS = {
    "Licensed under the <a href='x'>Apache License</a>, Version 2.0.": "apache-2.0",
    "<p>Released under\nthe <b>MIT</b>\nLicense.</p>": "mit",
    "Copyright 2020 Some Authors and their friends; released under the MIT License, see the file beside this one": "mit",
    "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General\n"
    "# Public License as published by the Free Software Foundation;\n# either version 2.1 of the License, or later": "lgpl-2.1",
    "All rights reserved. Code and texts are licensed under the <i>Apache License</i>, Version 2.0 only.": "apache-2.0",
    "All rights reserved.": "proprietary",
    "Das Haus ist mit einer Garage und der License nicht gemeint.": None,
    "The public library has general rules, version 3 of them.": None,
}


def own(spark, texts):
    rows = spark.createDataFrame([(k, f"http://h.example/{k}/LICENSE", t) for k, t in enumerate(texts)],
                                 "page_id long, url string, html string")
    return {r["id"]: r["own_license"] for r in licenses.scan(rows).collect()}


def test_headers(spark):
    got = own(spark, FORMS)
    assert [got[k] for k in range(len(FORMS))] == list(FORMS.values())


@pytest.mark.skipif(not TEXTS.is_dir(), reason="no licence texts here")
def test_whole_texts(spark):
    want = {"BSD": "bsd-3-clause", "GPL-1": "gpl-1.0", "GPL-2": "gpl-2.0", "GPL-3": "gpl-3.0", "LGPL-2.1": "lgpl-2.1",
            "LGPL-3": "lgpl-3.0", "MPL-1.1": "mpl-1.1", "MPL-2.0": "mpl-2.0", "CC0-1.0": "cc0-1.0", "Apache-2.0": "apache-2.0"}
    texts = [(TEXTS / f).read_text() for f in want]
    got = own(spark, texts + ["MIT License\n\nCopyright (c) 2024 A. Person\n\n" + "<pre>" + texts[0] + "</pre>"])
    assert [got[k] for k in range(len(want))] == list(want.values()) and got[len(want)] == "bsd-3-clause"
