"""Notices inside other text, across line breaks, and in longer licence texts."""

import re

import pytest

from troughline.llm import licenses

CASES = [
    ("MIT", "Licensed under the MIT License. See License.txt in the project root for license information."),
    ("MIT", "# Copyright (c) 2020 The Authors. All rights reserved. Released under the MIT License. Do not remove this header."),
    ("Apache-2.0", "// Licensed under the Apache\n// License, Version 2.0 (the \"License\"); you may not use this file except in compliance."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
    ("GPL-2.0", "x is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or more"),
    ("MIT", "MIT License\n\nCopyright (c) 2021 A\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell"),
    (None, "a permission to enter and a licence to drive are two things that one may lose under the law of the land"),
    (None, "nothing at all"),
    ("MIT", ("word and word " * 3000) + "released under the\nMIT license. " + ("more text " * 3000)),
]


def test_span_is_the_longest_template():
    assert max(len(re.findall(r"[^\W_]+", t)) for _, t in licenses.TEMPLATES) == licenses.SPAN


def test_notices_inside_other_text(spark):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(CASES)], "doc_id long, text string")
    got = {r.row: (r.licence, r.cosine) for r in licenses.best_templates(docs).collect()}
    assert {i: got.get(i, (None,))[0] for i in range(len(CASES))} == {i: want for i, (want, _) in enumerate(CASES)}
    assert got[0][1] == pytest.approx(1.0) == got[8][1]
