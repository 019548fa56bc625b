import math
import re
from collections import Counter

from lumora.llm import licenses as L

from ..conftest import rows


def test_scan_and_inheritance(spark):
    mit = "Released under the MIT License."
    data = [
        (1, "/a/LICENSE", mit, None),
        (2, "/a/b/x.py", "code", None),
        (3, "/a/b/c/y.py", "# Licensed under the Apache License, Version 2.0.\ncode", None),
        (4, "/a/b/c/z.py", None, None),
        (5, "/d/w.py", "", None),
        (6, "/d/COPYING", "This work is licensed under the GNU General Public License, version 3.", None),
        (7, "/a/b/NOTICE", "no licence that is known", None),
        (8, None, "x", None),
        (9, "/ab/q.py", "x", None),
        (10, "/a/LICENSE.txt", "Licensed under CC BY-NC 4.0.", None),
    ]
    df = spark.createDataFrame([(*r, "t") for r in data], "doc_id long, path string, text string, is_file boolean, license string")
    got = {r[0]: (r[2], r[4]) for r in rows(L.scan(df))}
    assert got == {
        1: ("MIT", None), 2: ("MIT", "/a/LICENSE"), 3: ("Apache-2.0", None), 4: ("MIT", "/a/LICENSE"), 5: ("GPL-3.0", "/d/COPYING"), 6: ("GPL-3.0", None),
        7: ("MIT", "/a/LICENSE"), 8: (None, None), 9: (None, None), 10: ("CC-BY-NC-4.0", None),
    }
    assert L.scan(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "/a", "x", None)], "doc_id long, path string, text string, is_file boolean")
    plan = L.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def cosines(texts, passage):
    """The largest cosine of a passage to each licence, by a plain count over all texts."""
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    df = Counter(w for t in texts for w in set(words(t)))
    weigh = lambda t: {w: n * math.log((len(texts) + 1) / (df[w] + 1)) for w, n in Counter(words(t)).items()}
    norm = lambda a: math.sqrt(sum(x * x for x in a.values()))
    p, out = weigh(passage), {}
    for name, t in L.TEMPLATES:
        q = weigh(t)
        out[name] = max(out.get(name, 0), sum(x * q.get(w, 0) for w, x in p.items()) / (norm(p) * norm(q)))
    return out


def test_document_frequencies_are_those_of_all_terms(spark):
    notice = "Released under the MIT License, as the rest is."
    texts = [notice, None, ""] + ["as the rest is under it"] * 900 + [f"word{i}" for i in range(97)]
    df = spark.createDataFrame([(i, f"/{i}/x", t, None) for i, t in enumerate(texts)], "doc_id long, path string, text string, is_file boolean")
    got = {r[0]: (r[2], r[3]) for r in rows(L.scan(df))}
    want = cosines(texts, notice)
    assert got[0][0] == max(want, key=want.get) == "MIT" and abs(got[0][1] - want["MIT"]) < 2e-6 and got[0][1] >= L.THRESHOLD
    assert all(v == (None, None) for k, v in got.items() if k)


def test_headers_files_and_tags_go_to_their_own_licence(spark):
    """Every template, and forms with other words beside them, in a corpus of prose; each finds its own licence."""
    prose = [f"the rest of it is for any work of the author number{i % 40} as is and by that use or not" for i in range(400)]
    asked = {f"/t{i}/x": (text, name) for i, (name, text) in enumerate(L.TEMPLATES)}
    asked |= {
        "/a1/x": ("# SPDX-License-Identifier: MIT", "MIT"), "/a2/x": ("code\n// SPDX-License-Identifier: Apache-2.0 OR MIT\n", "Apache-2.0 OR MIT"), "/a3/x": ("Licensed under the MIT license (see LICENSE)", "MIT"),
        "/a4/x": ("CC BY 4.0", "CC-BY-4.0"), "/a5/x": ("CC BY-SA 4.0", "CC-BY-SA-4.0"), "/a6/x": ("GNU General Public License v3", "GPL-3.0"), "/a7/x": ("SPDX-License-Identifier: WTFPL", "WTFPL"),
        "/a8/LICENSE": ("BSD 3\n\n" + L._BSD + "\n\n" + L._BSD_3 + "\n\n" + L._BSD_END, "BSD-3-Clause"),
    }
    data = [(i, f"/p{i}/y", t, None) for i, t in enumerate(prose)] + [(1000 + i, path, text, None) for i, (path, (text, _)) in enumerate(asked.items())]
    df = spark.createDataFrame(data, "doc_id long, path string, text string, is_file boolean")
    got = {r[1]: r[2] for r in rows(L.scan(df))}
    assert {p: got[p] for p in asked} == {p: name for p, (_, name) in asked.items()}
    assert not any(got[f"/p{i}/y"] for i in range(400))


def test_repeated_rows_ties_and_long_texts(spark):
    mit, cc = "Released under the MIT License.", "Licensed under CC BY-NC 4.0."
    data = [(1, "/a/x", mit), (1, "/b/x", "nothing"), (1, "/a/x", mit), (None, "/c/x", cc), (2, "/d/x", f"{cc}\n{mit}"), (3, "/e/x", "word " * 200_000 + "\n" + mit)]
    df = spark.createDataFrame([(*r, None) for r in data], "doc_id long, path string, text string, is_file boolean")
    got = [(r[0], r[1], r[2]) for r in rows(L.scan(df))]
    assert got == [(None, "/c/x", "CC-BY-NC-4.0"), (1, "/a/x", "MIT"), (1, "/a/x", "MIT"), (1, "/b/x", None), (2, "/d/x", "CC-BY-NC-4.0"), (3, "/e/x", "MIT")]
