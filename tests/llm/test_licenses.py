import brute
import pytest

from leasemill.llm import licenses as L


def found(docs):
    return {r["doc_id"]: r["f"] for r in docs.select("doc_id", L.scan(docs).alias("f")).collect()}


def test_base_places(documents):
    texts = ["Under the MIT license, under-the mit LICENSE", "apache license version 2.0 cc by-nc", "under the mit", None, "", "é" * 100_000 + " cc by nc",
             "under the mitx license", "cc by cc by nc nc"]
    docs = documents(list(enumerate(texts)), "labels")
    got = found(docs)
    phrases = [(label, p.split()) for label, p in L.BASE]
    for i, text in enumerate(texts):
        w = brute.words(text)
        at = [(k, label) for label, p in phrases for k in range(len(w)) if w[k : k + len(p)] == p]
        starts = [k for k, _ in at]
        assert (got[i]["n_words"], got[i]["n_base"]) == (len(w), len(at))
        assert (got[i]["first_word"], got[i]["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert got[i]["base_labels"] == ",".join(sorted({label for _, label in at}))
        assert set(got[i]["base_labels"].split(",")) <= set(got[i]["labels"].split(",")) | {""}
        assert 0 <= got[i]["score"] < 1 and (got[i]["score"] > 0) == bool(got[i]["labels"])


def test_regions(documents):
    texts = {
        0: "licensed under the GNU General Public License, version 3",
        1: "This big work is licensed under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3",
        2: "licensed under the gnu public license version 3",
        3: "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine tool and associated documentation files",
        4: "Permission is hereby granted, free of charge, to any person obtaining a copy of this and associated documentation files",
        5: "SPDX-License-Identifier: Zlib",
    }
    got = found(documents(list(texts.items())))
    assert {i: r["labels"] for i, r in got.items()} == {0: "gpl-3", 1: "gpl-3", 2: "", 3: "mit", 4: "", 5: "spdx"}
    assert got[1]["places"][0]["first_word"] == 0 and got[1]["places"][0]["end_word"] == len(brute.words(texts[1]))
    assert got[3]["score"] > got[0]["score"]


GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version %s of the License, or (at your option) any later version."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def test_standard_notices_and_whole_texts(documents):
    typographic = MIT.replace('"Software"', "“Software”").replace('"AS IS"', "“AS IS”").replace("NONINFRINGEMENT", "NON-INFRINGEMENT")
    third = BSD[BSD.index("3. ") : BSD.index("THIS SOFTWARE")]
    texts = {
        0: (GPL_NOTICE % 3, "gpl-3"),
        1: (GPL_NOTICE % 2, "gpl-2"),
        2: ("GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007", "gpl-3"),
        3: (GPL_NOTICE.replace("GNU General", "GNU Lesser General") % 3, "lgpl"),
        4: (MIT, "mit,mit-text"),
        5: (typographic, "mit,mit-text"),
        6: (MIT.replace("shall be included", "need not be included"), "mit"),
        7: (MIT[: MIT.index("THE SOFTWARE IS")], "mit"),
        8: (BSD, "bsd,bsd-text"),
        9: (BSD.replace(third, ""), "bsd,bsd-text"),
        10: (BSD.replace(third, "3. The software shall be used for good.\n"), "bsd"),
        11: (BSD.replace("must retain", "may drop"), "bsd"),
    }
    got = found(documents([(i, t) for i, (t, _) in texts.items()]))
    assert {i: r["labels"] for i, r in got.items()} == {i: label for i, (_, label) in texts.items()}
    assert got[4]["score"] > got[7]["score"] and max(p["end_word"] for p in got[4]["places"]) == len(brute.words(MIT))


def test_templates_have_to_be_closed():
    for bad in ("[[a", "[[only optional]]", "{{1..2}}"):
        with pytest.raises(ValueError):
            L.compile_template("x", bad)
    assert found_none(L.compile_template("x", "a {{0..2}} b [[c [[d]]]] e"), "a x y z b e")


def found_none(automaton, text):
    hashes = [L.word_hash(w) for w in text.split()]
    ok = [L.word_hash(w) for w in "a x b c e".split()]
    return automaton.longest(hashes, 0, len(hashes)) == -1 and automaton.longest(ok, 0, 5) == 5


def test_no_rows(documents):
    docs = documents([])
    assert docs.select(L.scan(docs)).count() == 0
