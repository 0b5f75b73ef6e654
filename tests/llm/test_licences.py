from lectern.llm import licences

MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."


def found(spark, files):
    rows = licences.scan(spark.createDataFrame(files, "path string, text string")).collect()
    return {r.path: (r.licence, r.via, r.licence_path) for r in rows}


def test_own_and_inherited(spark):
    body = "nothing of the sort here\n" * 40
    out = found(spark, [("LICENSE", MIT), ("a/LICENSE.txt", GPL), ("a/x.py", body), ("a/b/c/y.py", body), ("z.py", body), ("a/own.py", body + MIT), ("ab/w.py", body), (None, body), ("a/empty", ""), ("a/null", None)])
    assert out["a/x.py"] == ("GPL-3.0", "inherited", "a/LICENSE.txt") == out["a/b/c/y.py"] == out["a/empty"] == out["a/null"]
    assert out["z.py"] == ("MIT", "inherited", "LICENSE") == out["ab/w.py"]
    assert out["a/own.py"] == ("MIT", "own", "a/own.py")
    assert out[None] == (None, "none", None)


def test_headers(spark):
    apache = '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\ncode = 1'
    other = "The licensed premises closed early after quarrels between neighbours about noise, parking and dogs"
    out = found(spark, [("p/a.py", apache), ("q/b.txt", other), ("r/c.txt", "Licensed under CC BY-NC 4.0."), ("s/d", "Copyright 2020 Acme. All rights reserved.")])
    assert {k: v[0] for k, v in out.items()} == {"p/a.py": "Apache-2.0", "q/b.txt": None, "r/c.txt": "CC-BY-NC-4.0", "s/d": "Proprietary"}


def test_plan_has_no_python(spark, sf):
    plan = licences.op8_licences(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


BSD = """Copyright (c) 2019, The Example Authors
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
GPL_FILE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.
"""
APACHE_FILE = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.
"""
ISC = """Copyright (c) 2021 A. Person

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""


def test_licence_files(spark):
    files = {"a/LICENSE": BSD + THIRD, "b/LICENSE": BSD, "c/COPYING": GPL_FILE, "d/LICENSE": APACHE_FILE, "e/LICENSE": ISC}
    out = found(spark, [*files.items(), *((f"{x}/src/main.py", "print(1)") for x in "abcde")])
    want = {"a": "BSD-3-Clause", "b": "BSD-2-Clause", "c": "GPL-3.0", "d": "Apache-2.0", "e": "ISC"}
    assert {k: out[f"{k}/src/main.py"][:2] for k in want} == {k: (v, "inherited") for k, v in want.items()}


def test_spdx_lines(spark):
    lines = {"MIT": "MIT", "GPL-3.0-or-later": "GPL-3.0", "GPL-2.0-only": "GPL-2.0", "Apache-2.0": "Apache-2.0", "BSD-2-Clause": "BSD-2-Clause", "LGPL-2.1-or-later": "LGPL-2.1", "Zlib": "Zlib"}
    out = found(spark, [(f"{i}/x.c", f"// SPDX-License-Identifier: {name}\nint main() {{ return {i}; }}") for i, name in enumerate(lines)])
    assert [out[f"{i}/x.c"][0] for i in range(len(lines))] == list(lines.values())
