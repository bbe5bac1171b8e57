"""The template table of the licence scan: ``TEMPLATES[licence] = (text, ...)``.

Per licence: the whole text where ``licence_texts/`` holds it, the standard
header, and the short forms people write (name and version, abbreviation with
version, the notices of ``NOTICES``). Copyright lines are not part of a
template. A short form always has two words or more, or is a word that means
nothing else (``GPLv3``): the bare words MIT, ISC or Apache are no notice.

Texts in ``licence_texts/`` are copies of the published ones, except for
AGPL-3.0 (the GPL-3.0 text with its own title, preamble and section 13) and
the Creative Commons 4.0 texts other than BY-SA (the BY-SA text changed where
the licences differ): these are composed, and may differ from the published
wording by a few words. Licences of ``WITHOUT_TEXT`` have notices only.
"""

from __future__ import annotations

from importlib import resources

#: fixed values: usual short notices of published licences
NOTICES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without "
                    "modification, are permitted.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 "
                 "International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
                    "International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and "
               "related rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, "
               "v. 2.0.",
    "proprietary": "All rights reserved.",
}

GNU = {"GPL": ("General Public License", "program", ("1.0", "2.0", "3.0")),
       "LGPL": ("Lesser General Public License", "library", ("2.1", "3.0")),
       "AGPL": ("Affero General Public License", "program", ("3.0",))}
GNU_HEADER = (
    "This {what} is free software; you can redistribute it and/or modify it under the terms of "
    "the GNU {name} as published by the Free Software Foundation; either version {v} of the "
    "License, or (at your option) any later version.",
    "This {what} is free software; you can redistribute it and/or modify it under the terms of "
    "the GNU {name} as published by the Free Software Foundation; version {v}.",
    "This {what} is free software; you can redistribute it and/or modify it under the terms of "
    "the GNU {name} as published by the Free Software Foundation; either version {v} of the "
    "License, or (at your option) any later version. This {what} is distributed in the hope that "
    "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.")

CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
      "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
      "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"1.0": ("Generic",), "2.0": ("Generic",), "2.5": ("Generic",),
               "3.0": ("Unported", "United States"), "4.0": ("International",)}

#: name and version, as written in full; abbreviations
NAMED = {
    "AFL-3.0": ("Academic Free License version 3.0", "AFL 3.0"),
    "Apache-1.1": ("Apache License, Version 1.1", "Apache Software License 1.1", "Apache 1.1"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0",
                   "Apache Software License 2.0", "Apache License v2.0", "Apache v2",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not "
                   "use this file except in compliance with the License. You may obtain a copy of "
                   "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
                   "applicable law or agreed to in writing, software distributed under the License "
                   "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
                   "KIND, either express or implied. See the License for the specific language "
                   "governing permissions and limitations under the License."),
    "Artistic-1.0": ("Artistic License 1.0",),
    "Artistic-2.0": ("Artistic License 2.0", "The Artistic License Version 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-clause BSD license", "Simplified BSD License",
                     "FreeBSD License", "BSD 2 Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-clause BSD license", "New BSD License",
                     "Modified BSD License", "Revised BSD License", "BSD 3 Clause"),
    "BSD-style": ("Use of this source code is governed by a BSD-style license that can be found "
                  "in the LICENSE file.", "BSD-style license"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0",
                "Distributed under the Boost Software License, Version 1.0. (See accompanying file "
                "LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero v1.0 Universal",
                "CC0 1.0 Universal Public Domain Dedication"),
    "CC-PDM-1.0": ("Public Domain Mark 1.0",
                   "This work is free of known copyright restrictions."),
    "CDDL-1.0": ("Common Development and Distribution License Version 1.0", "CDDL 1.0",
                 "The contents of this file are subject to the terms of the Common Development and "
                 "Distribution License (the \"License\"). You may not use this file except in "
                 "compliance with the License."),
    "ECL-2.0": ("Educational Community License, Version 2.0", "ECL 2.0"),
    "EPL-1.0": ("Eclipse Public License - v 1.0", "Eclipse Public License 1.0", "EPL 1.0",
                "Eclipse Public License version 1.0", "This program and the accompanying materials "
                "are made available under the terms of the Eclipse Public License v1.0 which "
                "accompanies this distribution, and is available at "
                "http://www.eclipse.org/legal/epl-v10.html"),
    "EPL-2.0": ("Eclipse Public License - v 2.0", "Eclipse Public License 2.0", "EPL 2.0",
                "Eclipse Public License version 2.0", "This program and the accompanying materials "
                "are made available under the terms of the Eclipse Public License 2.0 which is "
                "available at https://www.eclipse.org/legal/epl-2.0/"),
    "EUPL-1.1": ("European Union Public Licence V. 1.1", "EUPL 1.1",
                 "Licensed under the EUPL, Version 1.1"),
    "EUPL-1.2": ("European Union Public Licence v. 1.2", "EUPL 1.2",
                 "Licensed under the EUPL, Version 1.2"),
    "GFDL-1.2": ("GNU Free Documentation License, Version 1.2", "GFDL 1.2"),
    "GFDL-1.3": ("GNU Free Documentation License, Version 1.3", "GFDL 1.3",
                 "Permission is granted to copy, distribute and/or modify this document under the "
                 "terms of the GNU Free Documentation License, Version 1.3 or any later version "
                 "published by the Free Software Foundation; with no Invariant Sections, no "
                 "Front-Cover Texts, and no Back-Cover Texts."),
    "ISC": ("ISC License", "Licensed under the ISC License.", "Released under the ISC License."),
    "LGPL-2.0": ("GNU Library General Public License version 2",),
    "MIT": ("MIT License", "Licensed under the MIT License.", "Licensed under MIT",
            "This project is licensed under the MIT License", "MIT licensed", "MIT Licence",
            "Expat License"),
    "MIT-0": ("MIT No Attribution",),
    "MPL-1.1": ("Mozilla Public License Version 1.1", "Mozilla Public License 1.1", "MPL 1.1",
                "The contents of this file are subject to the Mozilla Public License Version 1.1 "
                "(the \"License\"); you may not use this file except in compliance with the "
                "License."),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "Mozilla Public License 2.0", "MPL 2.0",
                "Mozilla Public License, v. 2.0",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. "
                "2.0. If a copy of the MPL was not distributed with this file, You can obtain one "
                "at http://mozilla.org/MPL/2.0/."),
    "MS-PL": ("Microsoft Public License",),
    "ODbL-1.0": ("Open Database License v1.0", "Open Data Commons Open Database License",
                 "ODbL 1.0"),
    "ODC-BY-1.0": ("Open Data Commons Attribution License", "ODC-BY 1.0"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "OFL 1.1",
                "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    "PDDL-1.0": ("Public Domain Dedication and License", "PDDL 1.0"),
    "PSF-2.0": ("Python Software Foundation License Version 2", "PSF License"),
    "Unlicense": ("The Unlicense", "Released under the Unlicense"),
    "WTFPL": ("Do What The Fuck You Want To Public License", "WTFPL"),
    "Zlib": ("zlib License", "zlib/libpng license"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD"),
    "proprietary": ("All rights are reserved.", "Alle Rechte vorbehalten", "Tous droits réservés",
                    "Todos los derechos reservados", "Tutti i diritti riservati",
                    "Todos os direitos reservados"),
}

#: words that tell one licence from another: with the numbers, those that a short
#: template has must stand in what matches it ("Foo License, Version 2.0" has four
#: of the five words of Apache's name and is not it)
NAMES = frozenset(
    "academic affero afl agpl apache artistic attribution boost bsd by cc cc0 cddl commons creative "
    "database documentation domain ecl eclipse educational epl eupl european expat freebsd gfdl gnu "
    "gpl isc lesser lgpl library libpng mark microsoft mit modified mozilla mpl nc nd new "
    "noderivatives noderivs noncommercial odbl odc ofl pddl psf python revised sa sharealike "
    "simplified sil unlicense wtfpl zero zlib".split())

#: licences with a file in ``licence_texts/``
WITH_TEXT = (
    "0BSD", "AGPL-3.0", "Apache-2.0", "Artistic-1.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0",
    "CC-BY-3.0-US", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0",
    "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "GFDL-1.2", "GFDL-1.3",
    "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1",
    "MPL-2.0", "OFL-1.1", "Unlicense", "WTFPL", "Zlib")


def gnu_forms() -> dict[str, list[str]]:
    out = {}
    for short, (name, what, versions) in GNU.items():
        for version in versions:
            v = version.removesuffix(".0")
            forms = [h.format(what=w, name=name, v=v)
                     for h in GNU_HEADER for w in dict.fromkeys((what, "program"))]
            for x in dict.fromkeys((v, version)):
                forms += [f"GNU {name} version {x}", f"GNU {name} v{x}", f"GNU {name} {x}",
                          f"version {x} of the GNU {name}", f"GNU {short} version {x}",
                          f"GNU {short} v{x}", f"{short} version {x}", f"{short} v{x}",
                          f"{short}v{x}", f"{short} {x}",
                          f"This work is licensed under the GNU {name}, version {x}."]
            out[f"{short}-{version}"] = forms
    return out


def creative_commons_forms() -> dict[str, list[str]]:
    out = {}
    for short, elements in CC.items():
        names = dict.fromkeys((elements, elements.replace("NoDerivatives", "NoDerivs"),
                               elements.replace("NonCommercial", "Noncommercial").replace(
                                   "ShareAlike", "Share Alike").replace(
                                   "Noncommercial", "Non-Commercial")))
        for version, ports in CC_VERSIONS.items():
            forms = [f"CC {short} {version}", f"CC-{short} v{version}",
                     f"Licensed under CC {short} {version}.",
                     f"This work is licensed under CC {short} {version}."]
            for name in names:
                forms += [f"Creative Commons {name} {version}",
                          f"Creative Commons {name} {version} License",
                          f"This work is licensed under the Creative Commons {name} {version} "
                          "License."]
                for port in ports:
                    forms += [f"{name} {version} {port}",
                              f"Creative Commons {name} {version} {port} License",
                              f"This work is licensed under a Creative Commons {name} {version} "
                              f"{port} License.",
                              f"This work is licensed under the Creative Commons {name} {version} "
                              f"{port} License. To view a copy of this license, visit "
                              f"http://creativecommons.org/licenses/{short.lower()}/{version}/ or "
                              "send a letter to Creative Commons, PO Box 1866, Mountain View, CA "
                              "94042, USA."]
            out[f"CC-{short}-{version}"] = forms
    return out


def load() -> dict[str, tuple[str, ...]]:
    table: dict[str, list[str]] = {}
    for forms in ({k: [v] for k, v in NOTICES.items()}, NAMED, gnu_forms(),
                  creative_commons_forms()):
        for licence, texts in forms.items():
            table.setdefault(licence, []).extend(texts)
    folder = resources.files(__package__) / "licence_texts"
    for licence in WITH_TEXT:
        table.setdefault(licence, []).append((folder / f"{licence}.txt").read_text("utf-8"))
    return {k: tuple(dict.fromkeys(v)) for k, v in sorted(table.items())}


TEMPLATES = load()
#: licences known by notices and names only
WITHOUT_TEXT = tuple(k for k in TEMPLATES if k not in WITH_TEXT)
