"""Which license a notice is returned as: all rows, not only those of a wanted license."""

import pandas as pd
import pytest

from lateweave.llm import licenses
from lateweave.llm.queries import op4_licenses

SMALL = "/root/testdata/sf0.01"
GNU = "This work is licensed under the GNU "
CC = "This work is licensed under a Creative Commons "
TEXTS = {
    "Licensed under CC BY-SA 4.0.": ["CC-BY-SA-4.0-short"],
    "Licensed under CC BY 4.0.": ["CC-BY-4.0-short"],
    "Licensed under CC BY-XX 4.0.": [],
    GNU + "General Public License, version 2.": ["GPL-2.0-notice"],
    GNU + "General Public License, version 3.1.": [],
    GNU + "General Public License v3.0": ["GPL-3.0-notice"],
    GNU + "Lesser General Public License, version 3.": ["LGPL-3.0-notice"],
    CC + "Attribution-NonCommercial 4.0 International License.": ["CC-BY-NC-4.0-long"],
    CC + "Attribution-Share Alike 3.0 Unported License.": ["CC-BY-SA-3.0-notice"],
    "Released under the BSD License.": ["BSD-notice"],
    "Released under the 3-Clause BSD License.": ["BSD-3-Clause-notice"],
    "Released under the modified MIT-0 License.": [],
    "All of the rights are reserved.": [],
    "Licensed under the Apache License, Version 2.0. All rights reserved.": ["Apache-2.0-notice", "reserved"],
    "Released under the BSD License. Parts are released under the MIT License.": ["BSD-notice", "MIT-notice"],
    f"{GNU}General Public License, version 2. {GNU}General Public License, version 3.": [
        "GPL-2.0-notice", "GPL-3.0-notice"],
    "MIT License\n\nCopyright (c) 2020 A. Writer": ["MIT-head"],
    "The MIT License (MIT)": ["MIT-title"],
    "This is licensed under MIT.": ["MIT-brief"],
    "Released under MIT, as before": ["MIT-brief-released"],
    "licensed under a deal with MIT": [],
    "licensed under MIT-0": ["MIT-0-brief"],
    "It is licensed under the GNU GPL v3.": ["GPL-3.0-brief-3"],
    "distributed under the GNU GPL version 2": ["GPL-2.0-brief-4"],
    "licensed under the GPLv3": ["GPL-3.0-brief-2"],
    "licensed under LGPLv2.1": ["LGPL-2.1-brief-2"],
    "licensed under LGPLv2.2": [],
    "Licensed under GPL-3.0-or-later": ["GPL-3.0-or-later-brief"],
    "# SPDX-License-Identifier: MIT": ["MIT-spdx"],
    "# SPDX-License-Identifier: MIT-0.": ["MIT-0-spdx"],
    "# SPDX-License-Identifier: MIT-1": [],
    "// SPDX-License-Identifier: GPL-2.0-or-later */": ["GPL-2.0-or-later-spdx"],
    "// SPDX-License-Identifier: GPL-2.0+": [],
    "SPDX-License-Identifier: (MIT OR Apache-2.0)": ["MIT-spdx", "Apache-2.0-spdx"],
    "SPDX-License-Identifier: CC-BY-NC-SA-4.0": ["CC-BY-NC-SA-4.0-spdx"],
}


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE, licenses.KEYS)


def test_notices(scanner):
    assert {t: [row[0] for row in scanner.scan(t)] for t in TEXTS} == TEXTS


@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_a_template_is_its_own_best(scanner, name):
    text = f"Some words first. {licenses.TEMPLATES[name]} More words after it."
    assert [row[:2] for row in scanner.scan(text)] == [(name, 1.0)]


def test_all_rows_of_the_table(spark):
    """The notices of the given documents are literal, so nothing else may come back."""
    d = pd.read_parquet(f"{SMALL}/documents.parquet")
    want = sorted((i, n, t.count(x)) for i, t in zip(d.doc_id, d.text) for n, x in licenses.TEMPLATES.items() if x in t)
    got = op4_licenses(spark, SMALL).toPandas()
    assert (got.coverage == 1).all()
    counts = got.groupby(["doc_id", "license"]).size()
    assert sorted((i, n, c) for (i, n), c in counts.items()) == want
