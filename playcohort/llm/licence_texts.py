"""What the licence classifier is taught: names, identifiers and sentences by family.

The wordings are generated: every name of a family in every frame, and every identifier in
every frame for identifiers. Sentences of the licence texts stand as they are.
"""

from __future__ import annotations

# Names of the licences by family.
NAMES = {
    "agpl": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL", "AGPL license", "AGPLv3", "GNU AGPL v3"],
    "apache": ["Apache License", "Apache License, Version 2.0", "Apache 2.0 license", "Apache License 2.0", "Apache Software License"],
    "boost": ["Boost Software License", "Boost Software License, Version 1.0", "Boost license"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "3-clause BSD license", "2-clause BSD license", "new BSD license", "simplified BSD license", "BSD-style license"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nd": ["CC BY-ND 4.0", "CC BY-ND 3.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NoDerivs License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"],
    "epl": ["Eclipse Public License", "Eclipse Public License 2.0", "Eclipse Public License v1.0", "Eclipse Public License, Version 2.0"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 2", "GNU General Public License, version 3", "GNU GPL", "GNU GPL v2", "GNU GPL v3", "GPL license", "GPLv2", "GPLv3"],
    "isc": ["ISC License", "ISC licence"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "GNU LGPL", "LGPL license", "LGPLv2.1", "LGPLv3"],
    "mit": ["MIT License", "MIT licence", "MIT-style license", "Expat License"],
    "mpl": ["Mozilla Public License", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"],
    "public-domain": ["CC0 1.0 Universal", "Creative Commons Zero", "CC0 license", "Unlicense", "public domain dedication"],
    "proprietary": [],
}
# Identifiers by family; those of the GNU family also with ``-only`` and ``-or-later``.
IDENTIFIERS = {
    "agpl": ["AGPL-3.0"],
    "apache": ["Apache-2.0"],
    "boost": ["BSL-1.0"],
    "bsd": ["BSD-2-Clause", "BSD-3-Clause", "0BSD"],
    "cc-by": ["CC-BY-3.0", "CC-BY-4.0"],
    "cc-by-nc": ["CC-BY-NC-3.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"],
    "cc-by-nd": ["CC-BY-ND-3.0", "CC-BY-ND-4.0"],
    "cc-by-sa": ["CC-BY-SA-3.0", "CC-BY-SA-4.0"],
    "epl": ["EPL-1.0", "EPL-2.0"],
    "gpl": ["GPL-2.0", "GPL-3.0"],
    "isc": ["ISC"],
    "lgpl": ["LGPL-2.0", "LGPL-2.1", "LGPL-3.0"],
    "mit": ["MIT"],
    "mpl": ["MPL-1.1", "MPL-2.0"],
    "public-domain": ["CC0-1.0", "Unlicense"],
    "proprietary": [],
}
GNU = ("agpl", "gpl", "lgpl")
SUFFIXES = ("", "-only", "-or-later")
#: Where a name stands in a notice (``{}``), and where an identifier does.
NAME_FRAMES = [
    "Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.",
    "This work is licensed under a {}.", "Distributed under the terms of the {}.", "Available under the {}.",
    "Published under the {}, see the file LICENSE.", "License: {}", "It is covered by the {}.",
]
IDENTIFIER_FRAMES = [
    "SPDX-License-Identifier: {}", "License: {}", "Licence: {}", "Released under the {} license.", "Licensed under {}.",
    "This file is {} licensed.", "{} licensed", "Distributed under {}.",
]
#: Notices that say the contrary; they are a class of their own.
NEGATED_FRAMES = [
    "Not licensed under the {}.", "This is not licensed under the {}.", "Not released under the {}.",
    "It is not distributed under the terms of the {}.", "No longer available under the {}.", "This was never published under the {}.",
]
#: A negation, at most two words, and what it denies.
NEGATION = r"(^| )(not|never|neither|nor|no longer|isn t|wasn t|aren t)( [^ ]+){0,2} (licensed|released|distributed|published|available|offered|covered|governed|under)( |$)"

# Usual sentences of notices by licence family.
SENTENCES = {
    "agpl": [
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "cc-by-sa": ["Text is available under the Creative Commons Attribution-ShareAlike License."],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    ],
    "gpl": [
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ],
    "lgpl": [
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "public-domain": [
        "This work has been dedicated to the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright to this work.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright by the author. All rights reserved.",
        "This document is proprietary and confidential; no part may be reproduced without written permission.",
    ],
}


def identifiers(family: str) -> list[str]:
    ends = SUFFIXES if family in GNU else ("",)
    return [name + end for name in IDENTIFIERS[family] for end in ends]


def identifying() -> list[str]:
    """Words that name a licence by an identifier or a short form with its version, lower-cased."""
    short = [word for names in NAMES.values() for name in names for word in name.split() if "PLv" in word]
    return sorted({name.lower().rstrip("+") for family in IDENTIFIERS for name in identifiers(family)} | {w.lower() for w in short})


def wordings(family: str) -> list[str]:
    """Every notice of a family that is taught."""
    by_name = [frame.format(name) for name in NAMES[family] for frame in NAME_FRAMES]
    by_id = [frame.format(name) for name in identifiers(family) for frame in IDENTIFIER_FRAMES]
    return [*SENTENCES.get(family, []), *by_name, *by_id]


def negated(family: str) -> list[str]:
    return [frame.format(name) for name in [*NAMES[family], *identifiers(family)] for frame in NEGATED_FRAMES]


def confirming(family: str) -> list[str]:
    """What confirms a family: its sentences, names, and identifiers where they cannot be a plain word."""
    marks = [name for name in identifiers(family) if "-" in name or any(c.isdigit() for c in name)]
    plain = [name for name in identifiers(family) if name not in marks]
    stated = [
        form.format(name) for name in plain for form in ("license {}", "licence {}", "{} licensed", "{} license", "under {}", "spdx-license-identifier {}")
    ]
    return [*SENTENCES.get(family, []), *NAMES[family], *marks, *stated]
