import math
import random
import re
import textwrap
from collections import Counter

from gleaner.llm import licenses

SCHEMA = "file_id long, path string, text string, license string, token int"


def scan(spark, rows):
    return {(r.file_id, r.path): r for r in licenses.scan_licenses(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)).collect()}


def test_headers_files_and_inheritance(spark):
    mit = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software."
    rows = [
        (1, "a/LICENSE", mit), (2, "a/x.py", "import os\nprint(1)"), (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"), (4, "a/b/z.py", "code"),
        (5, "c/w.py", "no word of it"), (6, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), (7, "a/b/c/d/v.py", ""), (8, "top.py", None), (9, None, "All rights reserved."),
        (10, "e/only.txt", "Licensed under CC BY-NC 4.0."), (11, "e/f/g.txt", "text"), (12, "h/two.txt", "words\nReleased under the MIT License.\nAll rights reserved."), (13, None, None),
    ]
    got = scan(spark, rows)
    assert len(got) == len(rows)
    what = {k[0]: (r.license, r.origin, r.from_path) for k, r in got.items()}
    assert what[1] == ("MIT", "file", "a/LICENSE") and what[2] == ("MIT", "inherited", "a/LICENSE")
    assert what[3] == ("Apache-2.0", "header", "a/b/y.py") and what[4] == ("MIT", "inherited", "a/LICENSE")
    assert what[5] == what[8] == what[13] == (None, None, None)
    assert what[6][:2] == ("GPL-3.0", "file") and what[7] == ("GPL-3.0", "inherited", "a/b/c/COPYING")
    assert what[9] == ("Proprietary", "file", None)
    assert what[10][:2] == ("CC-BY-NC-4.0", "file") and what[11] == ("CC-BY-NC-4.0", "inherited", "e/only.txt")
    assert got[12, "h/two.txt"].licenses == "MIT,Proprietary" and what[12][0] == "MIT"


def test_every_template_finds_itself(spark):
    rows = [(i, f"d{i}/f.c", f"start\n* {text}\nend") for i, (_, text) in enumerate(licenses.TEMPLATES)]
    got = scan(spark, rows)
    assert {k[0]: r.license for k, r in got.items()} == {i: name for i, (name, _) in enumerate(licenses.TEMPLATES)}


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a/b.c", "Released under the MIT License.\nx")] * 3
    out = licenses.scan_licenses(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    assert [r.license for r in out] == ["MIT"] * 3
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []


def wrapped(text, mark, width=60):
    return "\n".join(f"{mark}{line}" for part in text.split("\n\n") for line in [*textwrap.wrap(" ".join(part.split()), width), ""])


def test_whole_texts_headers_and_tags(spark):
    text = {file.stem: file.read_text() for file in licenses.TEXTS.glob("*.txt")}
    bsd = text["BSD-3-Clause"].replace("the copyright holder", "the University of Somewhere")
    rows, want = [], {}

    def add(path, body, license, origin):
        want[len(rows)] = (license, origin)
        rows.append((len(rows), f"r{len(rows)}/{path}", body))

    for name, whole in text.items():
        add("LICENSE", f"Copyright (c) 2021, Ada Example.\n\n{wrapped(whole, '', 66)}", name, "file")
    add("docs/terms.txt", "Copyright (c) 2021 Ada Example\n\n" + text["MIT"], "MIT", "file")
    add("x.c", "/*\n" + wrapped("Copyright (c) 2021, Ada Example\nAll rights reserved.\n\n" + bsd, " * ") + "\n */\nint main(void) { return 0; }\n" * 3, "BSD-3-Clause", "header")
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."
    for version in (2, 3):
        add("x.py", "#!/usr/bin/env python\n" + wrapped(gpl.format(version), "# ") + "\nimport os\nprint(os.sep)\n" * 9, f"GPL-{version}.0", "header")
    apache = text["Apache-2.0"]
    add("X.java", "/*\n" + wrapped(apache[apache.rindex("   Copyright [") :], " * ", 50) + "\n */\npackage x;\n", "Apache-2.0", "header")
    add("x.rs", "// SPDX-License-Identifier: MIT\nfn main() {}", "MIT", "header")
    add("x.h", "/* SPDX-License-Identifier: gpl-2.0-or-later WITH Linux-syscall-note */\nint a;", "GPL-2.0", "header")
    add("x.go", "// SPDX-License-Identifier: (MIT OR Apache-2.0)\npackage x", "Apache-2.0", "header")
    add("x.zig", "// SPDX-License-Identifier: EUPL-1.2\nconst a = 1;", "EUPL-1.2", "header")
    got = scan(spark, rows)
    assert {k[0]: (r.license, r.origin) for k, r in got.items()} == want
    assert [r.licenses for k, r in got.items() if k[1].endswith("x.go")] == ["Apache-2.0,MIT"]
    assert [r.licenses for k, r in sorted(got.items()) if k[1].endswith("x.py")] == ["GPL-2.0", "GPL-3.0"]


def test_bound_loses_no_text_like_a_template(spark):
    """Against cosines in plain Python, over texts of parts of templates and other words."""
    rng = random.Random(5)
    templates = licenses._template_words()
    texts = ["", "no licence at all", "released under the mit"]
    for _, _, words in templates:
        every = list(words.elements())
        for share in (0.2, 0.4, 0.6, 0.9, 1.0):
            part = rng.sample(every, max(1, int(share * len(every))))
            texts.append(" ".join(part + [f"other{chr(97 + rng.randrange(26))}" for _ in range(int(rng.random() * len(part)))]))
            texts.append(" ".join(dict.fromkeys(sorted(part, key=lambda w: words[w])[: max(1, len(part) // 2)])))
    found = 0
    for held in ({}, {"the": 900, "of": 700, "license": 40, "mit": 2}):
        weights = licenses.Weights(templates, 1000, held, 0.6)
        norms: dict[int, dict[str, float]] = {}
        for number, _, _, word, v in weights.rows:
            norms.setdefault(number, {})[word] = v
        want = set()
        for i, text in enumerate(texts):
            tf = Counter(re.findall(licenses.TOKEN, text))
            w = {x: (1 + math.log(n)) * weights.idf.get(x, weights.other) for x, n in tf.items()}
            norm = math.sqrt(sum(v * v for v in w.values())) or 1.0
            if max(sum(v * t.get(x, 0.0) for x, v in w.items()) / norm for t in norms.values()) >= 0.6:
                want.add(i)
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        got = {r.i for r in rows.where(weights.may_reach(rows.text) & weights.alike(rows.text)).collect()}
        assert want <= got, [texts[i][:80] for i in want - got]
        found += len(want)
        assert 1 not in got
    assert found > 300


def test_line_without_a_usual_word_is_compared(spark):
    got = scan(spark, [(1, "a/b.c", "int x;\n// Released under the MIT\nint y;"), (2, "c/d.c", "int z;")])
    assert got[1, "a/b.c"].license == "MIT" and got[2, "c/d.c"].license is None
