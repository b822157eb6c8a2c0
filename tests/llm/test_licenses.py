from lockstep.llm import licenses


def found(docs):
    return {r["doc_id"]: (list(r["sentence_ids"]), list(r["licenses"])) for r in licenses.find_licenses(docs).collect()}


def bsd(names):
    wanted = ["bsd-grant", "bsd-source", "bsd-binary"] + ["bsd-names"] * names
    return ". ".join(next(s for i, s in licenses.SENTENCES if i == k).upper() for k in wanted) + "."


def test_rules_follow_order_and_exclusions(docs_of):
    out = found(docs_of([
        (1, "Text.\nLicensed under the Apache License, Version 2.0."), (2, bsd(True)), (3, bsd(False)),
        (4, ". ".join(reversed(bsd(False).split(". ")))), (5, "Released under the  MIT-License!\n\nAll rights reserved. More"),
        (6, "nothing to see"), (7, "Released under the MIT License and others")]))
    assert out[1][1] == ["Apache-2.0"]
    assert out[2][1] == ["BSD-3-Clause"] and out[3][1] == ["BSD-2-Clause"] and out[4][1] == []
    assert out[5] == (["mit-notice", "reserved"], ["MIT", "Reserved"])
    assert 6 not in out and 7 not in out


def test_odd_rows(docs_of, spark):
    from tests.llm.brute import ODD_ROWS
    assert found(docs_of(ODD_ROWS)) == {}
    assert found(docs_of([])) == {}
    assert found(docs_of([(None, "Released under the MIT License."), (None, None)]))[None][1] == ["MIT"]
    long = "filler words here. " * 30_000 + "Licensed under CC BY-NC 4.0."
    assert found(docs_of([(1, long)]))[1][1] == ["CC-BY-NC-4.0"]


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"""
APACHE = """Licensed under the Apache License, Version 2.0 (the
"License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this"""
STANDARD = {"MIT": MIT, "Apache-2.0": APACHE, "GPL-3.0": GPL, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD + NAMES, "ISC": ISC, "MPL-2.0": MPL}


def test_wrapped_standard_texts(docs_of):
    leaders = ("", "# ", "// ", " * ", ";; ", "! ", "dnl ", "REM ", "-- ", "> ")
    cases = [(name, "\n".join(leader + line for line in text.split("\n"))) for name, text in STANDARD.items() for leader in leaders]
    cases += [(name, " ".join(text.split())) for name, text in STANDARD.items()]
    cases += [(name, text.replace("\n", "\r\n")) for name, text in STANDARD.items()]
    cases += [("BSD-3-Clause", (BSD + NAMES).replace("1. ", "1) ").replace("2. ", "(b) ").replace("3. ", "* "))]
    out = found(docs_of([(k, text) for k, (_, text) in enumerate(cases)]))
    for k, (name, text) in enumerate(cases):
        assert out.get(k, (0, 0))[1] == [name], text
    assert out[list(STANDARD).index("Apache-2.0") * len(leaders)][0] == ["apache-notice", "apache-use", "apache-copy", "apache-basis"]


def test_line_breaks_may_end_and_blank_lines_do(docs_of):
    out = found(docs_of([
        (1, "Licensed under the MIT License\nCopyright 2020 somebody"), (2, "Released under\n\nthe MIT License."),
        (3, "Released under. The MIT License."), (4, "# Released under\n#\n# the MIT License"),
        (5, "Licensed under the GNU General Public License, version\n3. More"), (6, "x|Released under the MIT License.|y"),
        (7, "\n" * 200_000 + "; " * 200_000 + "." * 200_000 + "x" + ":" * 200_000 + "y" + " " * 200_000 + "\nAll rights\nreserved")]))
    assert {k: v[1] for k, v in out.items()} == {1: ["MIT"], 5: ["GPL-3.0"], 7: ["Reserved"]}
