"""Hand-written license signatures.

One rule per line: priority, label, keyword, pattern. Patterns run over texts with A-Z in lower
case; a space in a pattern stands for any run of separators (spaces, line breaks, punctuation).
A text without the keyword cannot match. Higher priorities overrule lower ones that overlap.
"""

from __future__ import annotations

RULES_TEXT = r"""
90 | 0bsd | spdx | spdx license identifier 0bsd
90 | afl-3.0 | spdx | spdx license identifier afl 3 0
90 | agpl-3.0-only | spdx | spdx license identifier agpl 3 0(?: only)?
90 | agpl-3.0-or-later | spdx | spdx license identifier agpl 3 0(?: or later|\+)
90 | apache-1.1 | spdx | spdx license identifier apache 1 1
90 | apache-2.0 | spdx | spdx license identifier apache 2 0
90 | artistic-2.0 | spdx | spdx license identifier artistic 2 0
90 | bsd-2-clause | spdx | spdx license identifier bsd 2 clause
90 | bsd-3-clause | spdx | spdx license identifier bsd 3 clause
90 | bsd-4-clause | spdx | spdx license identifier bsd 4 clause
90 | bsl-1.0 | spdx | spdx license identifier bsl 1 0
90 | busl-1.1 | spdx | spdx license identifier busl 1 1
90 | cc0-1.0 | spdx | spdx license identifier cc0 1 0
90 | cc-by-3.0 | spdx | spdx license identifier cc by 3 0
90 | cc-by-4.0 | spdx | spdx license identifier cc by 4 0
90 | cc-by-nc-4.0 | spdx | spdx license identifier cc by nc 4 0
90 | cc-by-nc-nd-4.0 | spdx | spdx license identifier cc by nc nd 4 0
90 | cc-by-nc-sa-4.0 | spdx | spdx license identifier cc by nc sa 4 0
90 | cc-by-nd-4.0 | spdx | spdx license identifier cc by nd 4 0
90 | cc-by-sa-3.0 | spdx | spdx license identifier cc by sa 3 0
90 | cc-by-sa-4.0 | spdx | spdx license identifier cc by sa 4 0
90 | cddl-1.0 | spdx | spdx license identifier cddl 1 0
90 | cecill-2.1 | spdx | spdx license identifier cecill 2 1
90 | ecl-2.0 | spdx | spdx license identifier ecl 2 0
90 | epl-1.0 | spdx | spdx license identifier epl 1 0
90 | epl-2.0 | spdx | spdx license identifier epl 2 0
90 | eupl-1.2 | spdx | spdx license identifier eupl 1 2
90 | gfdl-1.3 | spdx | spdx license identifier gfdl 1 3
90 | gpl-2.0-only | spdx | spdx license identifier gpl 2 0(?: only)?
90 | gpl-2.0-or-later | spdx | spdx license identifier gpl 2 0(?: or later|\+)
90 | gpl-3.0-only | spdx | spdx license identifier gpl 3 0(?: only)?
90 | gpl-3.0-or-later | spdx | spdx license identifier gpl 3 0(?: or later|\+)
90 | isc | spdx | spdx license identifier isc
90 | lgpl-2.1-only | spdx | spdx license identifier lgpl 2 1(?: only)?
90 | lgpl-2.1-or-later | spdx | spdx license identifier lgpl 2 1(?: or later|\+)
90 | lgpl-3.0-only | spdx | spdx license identifier lgpl 3 0(?: only)?
90 | lgpl-3.0-or-later | spdx | spdx license identifier lgpl 3 0(?: or later|\+)
90 | mit | spdx | spdx license identifier mit
90 | mit-0 | spdx | spdx license identifier mit 0
90 | mpl-1.1 | spdx | spdx license identifier mpl 1 1
90 | mpl-2.0 | spdx | spdx license identifier mpl 2 0
90 | ms-pl | spdx | spdx license identifier ms pl
90 | ncsa | spdx | spdx license identifier ncsa
90 | odbl-1.0 | spdx | spdx license identifier odbl 1 0
90 | ofl-1.1 | spdx | spdx license identifier ofl 1 1
90 | postgresql | spdx | spdx license identifier postgresql
90 | psf-2.0 | spdx | spdx license identifier (?:psf|python) 2 0
90 | unlicense | spdx | spdx license identifier unlicense
90 | upl-1.0 | spdx | spdx license identifier upl 1 0
90 | wtfpl | spdx | spdx license identifier wtfpl
90 | zlib | spdx | spdx license identifier zlib
90 | spdx-other | spdx | spdx license identifier [a-z0-9][a-z0-9.+-]*
80 | agpl-3.0 | gnu affero | gnu affero general public license(?: agpl)? (?:version |v)?3
80 | agpl-3.0-or-later | gnu affero | gnu affero general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)?3 (?:of the license )?or (?:at your option )?any later version
80 | agpl-1.0 | affero general public license | affero general public license (?:version |v)?1
80 | apache-1.0 | apache | apache (?:software )?license (?:version |v)?1 0
80 | apache-1.1 | apache | apache (?:software )?license (?:version |v)?1 1
80 | apache-2.0 | apache | apache (?:software )?license (?:version |v)?2(?: 0)?
80 | apache-2.0-llvm | apache | apache license v2 0 with llvm exceptions
80 | artistic-1.0 | artistic licen | artistic license (?:version |v)?1 0
80 | artistic-2.0 | artistic licen | artistic license (?:version |v)?2 0
80 | afl-2.1 | academic free licen | academic free license (?:version |v)?2 1
80 | afl-3.0 | academic free licen | academic free license (?:version |v)?3 0
80 | boost-1.0 | boost software licen | boost software license (?:version |v)?1 0
80 | bsd-2-clause | licen | bsd 2 clause(?: simplified)? license
80 | bsd-2-clause | licen | (?:simplified|freebsd|2 clause|two clause) bsd license
80 | bsd-2-clause-patent | licen | bsd 2 clause plus patent license
80 | bsd-3-clause | licen | bsd 3 clause(?: new| revised| modified)? license
80 | bsd-3-clause | licen | (?:new|revised|modified|3 clause|three clause) bsd license
80 | bsd-3-clause-clear | licen | (?:clear bsd|bsd 3 clause clear) license
80 | bsd-4-clause | licen | (?:original|old|4 clause|four clause) bsd license
80 | bsd-4-clause | licen | bsd 4 clause(?: original| old)? license
80 | busl-1.1 | business source licen | business source license (?:version |v)?1 1
80 | cc0-1.0 | cc0 | cc0 1 0(?: universal)?
80 | cc0-1.0 | creative commons | creative commons (?:cc0|zero)(?: public domain dedication)?
80 | cc-by-1.0 | creative commons | creative commons attribution 1 0
80 | cc-by-2.0 | creative commons | creative commons attribution 2 0
80 | cc-by-2.5 | creative commons | creative commons attribution 2 5
80 | cc-by-3.0 | creative commons | creative commons attribution 3 0
80 | cc-by-4.0 | creative commons | creative commons attribution 4 0
80 | cc-by-sa-2.0 | creative commons | creative commons attribution share ?alike 2 0
80 | cc-by-sa-2.5 | creative commons | creative commons attribution share ?alike 2 5
80 | cc-by-sa-3.0 | creative commons | creative commons attribution share ?alike 3 0
80 | cc-by-sa-4.0 | creative commons | creative commons attribution share ?alike 4 0
80 | cc-by-nd-3.0 | creative commons | creative commons attribution no ?deriv(?:ative)?s? 3 0
80 | cc-by-nd-4.0 | creative commons | creative commons attribution no ?deriv(?:ative)?s? 4 0
80 | cc-by-nc-2.0 | creative commons | creative commons attribution non ?commercial 2 0
80 | cc-by-nc-3.0 | creative commons | creative commons attribution non ?commercial 3 0
80 | cc-by-nc-4.0 | creative commons | creative commons attribution non ?commercial 4 0
80 | cc-by-nc-sa-3.0 | creative commons | creative commons attribution non ?commercial share ?alike 3 0
80 | cc-by-nc-sa-4.0 | creative commons | creative commons attribution non ?commercial share ?alike 4 0
80 | cc-by-nc-nd-3.0 | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s? 3 0
80 | cc-by-nc-nd-4.0 | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s? 4 0
80 | cddl-1.0 | common development and distribution licen | common development and distribution license(?: cddl)? (?:version |v)?1 0
80 | cddl-1.1 | common development and distribution licen | common development and distribution license(?: cddl)? (?:version |v)?1 1
80 | cpl-1.0 | common public licen | common public license (?:version |v)?1 0
80 | ecl-2.0 | educational community licen | educational community license (?:version |v)?2 0
80 | epl-1.0 | eclipse public licen | eclipse public license (?:version |v)?1 0
80 | epl-2.0 | eclipse public licen | eclipse public license (?:version |v)?2 0
80 | eupl-1.1 | european union public licen | european union public licen[cs]e (?:version |v)?1 1
80 | eupl-1.2 | european union public licen | european union public licen[cs]e (?:version |v)?1 2
80 | gfdl-1.1 | gnu free documentation | gnu free documentation license (?:version |v)?1 1
80 | gfdl-1.2 | gnu free documentation | gnu free documentation license (?:version |v)?1 2
80 | gfdl-1.3 | gnu free documentation | gnu free documentation license (?:version |v)?1 3
80 | gpl-1.0 | gnu general public licen | gnu general public licen[cs]e(?: gpl)? (?:version |v)?1(?: 0)?
80 | gpl-2.0 | gnu general public licen | gnu general public licen[cs]e(?: gpl)? (?:version |v)?2(?: 0)?
80 | gpl-3.0 | gnu general public licen | gnu general public licen[cs]e(?: gpl)? (?:version |v)?3(?: 0)?
80 | gpl-2.0-or-later | gnu general public licen | gnu general public licen[cs]e as published by the free software foundation either version 2 of the license or at your option any later version
80 | gpl-3.0-or-later | gnu general public licen | gnu general public licen[cs]e as published by the free software foundation either version 3 of the license or at your option any later version
80 | gpl-2.0-classpath | gnu general public licen | gnu general public licen[cs]e (?:version |v)?2 with (?:the )?classpath exception
80 | lgpl-2.0 | gnu library general public | gnu library general public licen[cs]e (?:version |v)?2(?: 0)?
80 | lgpl-2.1 | gnu lesser general public | gnu lesser general public licen[cs]e(?: lgpl)? (?:version |v)?2 1
80 | lgpl-3.0 | gnu lesser general public | gnu lesser general public licen[cs]e(?: lgpl)? (?:version |v)?3(?: 0)?
80 | lgpl-2.1-or-later | gnu lesser general public | gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the license or at your option any later version
80 | lgpl-3.0-or-later | gnu lesser general public | gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the license or at your option any later version
80 | lppl-1.3c | latex project public licen | latex project public license (?:version |v)?1 3c?
80 | mpl-1.0 | mozilla public licen | mozilla public license(?: mpl)? (?:version |v)?1 0
80 | mpl-1.1 | mozilla public licen | mozilla public license(?: mpl)? (?:version |v)?1 1
80 | mpl-2.0 | mozilla public licen | mozilla public license(?: mpl)? (?:version |v)?2(?: 0)?
80 | ms-pl | microsoft public licen | microsoft public license(?: ms pl)?
80 | ms-rl | microsoft reciprocal licen | microsoft reciprocal license(?: ms rl)?
80 | odbl-1.0 | database licen | open (?:data commons )?(?:open )?database license(?: odbl)?(?: (?:version |v)?1 0)?
80 | odc-by-1.0 | open data commons | open data commons attribution license(?: (?:version |v)?1 0)?
80 | pddl-1.0 | open data commons | open data commons public domain dedication and licen[cs]e
80 | ofl-1.0 | sil open font licen | sil open font license (?:version |v)?1 0
80 | ofl-1.1 | sil open font licen | sil open font license (?:version |v)?1 1
80 | osl-2.1 | open software licen | open software license (?:version |v)?2 1
80 | osl-3.0 | open software licen | open software license (?:version |v)?3 0
80 | php-3.01 | php licen | php license (?:version |v)?3 01
80 | psf-2.0 | python software foundation licen | python software foundation license(?: version 2)?
80 | qpl-1.0 | q public licen | (?<![a-z])q public license(?: (?:version |v)?1 0)?
80 | sspl-1.0 | server side public licen | server side public license(?: (?:version |v)?1)?
80 | upl-1.0 | universal permissive licen | universal permissive license(?: (?:version |v)?1 0)?
80 | wtfpl | public licen | do what the fuck you want to public license
80 | zpl-2.1 | zope public licen | zope public license (?:version |v)?2 1
80 | elastic-2.0 | elastic licen | elastic license(?: (?:version |v)?2 0)
80 | polyform-nc-1.0 | polyform noncommercial licen | polyform noncommercial license(?: 1 0 0)?
80 | commons-clause | commons clause | commons clause license condition(?: (?:version |v)?1 0)?
80 | llama-2 | llama 2 community licen | llama 2 community license(?: agreement)?
80 | llama-3 | llama 3 community licen | llama 3 community license(?: agreement)?
80 | openrail-m | openrail | (?:creativeml |bigscience )?openrail(?: m)?(?: license)?
80 | openrail-m | open rail | (?:creativeml |bigscience )?open rail(?: m)?(?: license)?
70 | cc-by-4.0 | cc by | cc by 4 0
70 | cc-by-3.0 | cc by | cc by 3 0
70 | cc-by-2.0 | cc by | cc by 2 0
70 | cc-by-sa-4.0 | cc by | cc by sa 4 0
70 | cc-by-sa-3.0 | cc by | cc by sa 3 0
70 | cc-by-nc-4.0 | cc by | cc by nc 4 0
70 | cc-by-nc-3.0 | cc by | cc by nc 3 0
70 | cc-by-nd-4.0 | cc by | cc by nd 4 0
70 | cc-by-nd-3.0 | cc by | cc by nd 3 0
70 | cc-by-nc-sa-4.0 | cc by | cc by nc sa 4 0
70 | cc-by-nc-sa-3.0 | cc by | cc by nc sa 3 0
70 | cc-by-nc-nd-4.0 | cc by | cc by nc nd 4 0
70 | cc-by-nc-nd-3.0 | cc by | cc by nc nd 3 0
70 | mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
70 | isc | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
70 | bsd-family | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
70 | bsd-3-clause | names of its contributors | neither the names? of (?:(?!neither the name|nor the names of)[\s\S])++nor the names of its contributors may be used to endorse or promote products
70 | zlib | express or implied warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
70 | unlicense | released into the public domain | this is free and unencumbered software released into the public domain
70 | boost-1.0 | permission is hereby granted | permission is hereby granted free of charge to any person or organization obtaining a copy of the software
70 | gpl-notice | terms of the gnu | (?:redistribute it and or modify it )?under the terms of the gnu general public licen[cs]e
70 | lgpl-notice | terms of the gnu | (?:redistribute it and or modify it )?under the terms of the gnu lesser general public licen[cs]e
70 | agpl-notice | terms of the gnu | (?:redistribute it and or modify it )?under the terms of the gnu affero general public licen[cs]e
70 | apache-2.0 | apache.org/licenses | (?:https? )?(?:www )?apache org licenses license 2 0
70 | gpl-2.0 | gnu.org/licenses | (?:www )?gnu org licenses (?:old licenses )?gpl 2 0
70 | gpl-3.0 | gnu.org/licenses | (?:www )?gnu org licenses gpl 3 0
70 | lgpl-2.1 | gnu.org/licenses | (?:www )?gnu org licenses (?:old licenses )?lgpl 2 1
70 | lgpl-3.0 | gnu.org/licenses | (?:www )?gnu org licenses lgpl 3 0
70 | agpl-3.0 | gnu.org/licenses | (?:www )?gnu org licenses agpl 3 0
70 | mpl-2.0 | mozilla.org/mpl | (?:www )?mozilla org mpl 2 0
70 | mit | opensource.org/licenses | opensource org licenses mit(?: license)?
70 | bsd-2-clause | opensource.org/licenses | opensource org licenses bsd 2 clause
70 | bsd-3-clause | opensource.org/licenses | opensource org licenses bsd 3 clause
70 | isc | opensource.org/licenses | opensource org licenses isc
70 | apache-2.0 | opensource.org/licenses | opensource org licenses apache 2 0
70 | cc0-1.0 | creativecommons.org | creativecommons org publicdomain zero 1 0
70 | public-domain | creativecommons.org | creativecommons org publicdomain mark 1 0
70 | cc-by-4.0 | creativecommons.org | creativecommons org licenses by 4 0
70 | cc-by-3.0 | creativecommons.org | creativecommons org licenses by 3 0
70 | cc-by-sa-4.0 | creativecommons.org | creativecommons org licenses by sa 4 0
70 | cc-by-sa-3.0 | creativecommons.org | creativecommons org licenses by sa 3 0
70 | cc-by-nc-4.0 | creativecommons.org | creativecommons org licenses by nc 4 0
70 | cc-by-nd-4.0 | creativecommons.org | creativecommons org licenses by nd 4 0
70 | cc-by-nc-sa-4.0 | creativecommons.org | creativecommons org licenses by nc sa 4 0
70 | cc-by-nc-nd-4.0 | creativecommons.org | creativecommons org licenses by nc nd 4 0
60 | agpl | affero | (?:gnu )?affero general public licen[cs]e
60 | apache | apache | apache (?:software )?license
60 | artistic | artistic licen | (?:perl )?artistic license
60 | afl | academic free licen | academic free license
60 | bsd | licen | bsd(?: style| type)? licen[cs]e
60 | boost | boost software licen | boost software license
60 | cc-by | creative commons | creative commons attribution(?: international)?
60 | cc-by-sa | creative commons | creative commons attribution share ?alike
60 | cc-by-nc | creative commons | creative commons attribution non ?commercial
60 | cc-by-nd | creative commons | creative commons attribution no ?deriv(?:ative)?s?
60 | cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike
60 | cc-by-nc-nd | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s?
60 | cc-by-sa | cc by | cc by sa
60 | cc-by-nc | cc by | cc by nc
60 | cc-by-nd | cc by | cc by nd
60 | cc-by-nc-sa | cc by | cc by nc sa
60 | cc-by-nc-nd | cc by | cc by nc nd
60 | cecill | cecill | cecill(?: [abc])?(?: free software)? licen[cs]e(?: agreement)?
60 | cddl | common development and distribution licen | common development and distribution license
60 | epl | eclipse public licen | eclipse public license
60 | eupl | european union public licen | european union public licen[cs]e
60 | gfdl | gnu free documentation | gnu free documentation license
60 | gpl | general public licen | (?:gnu )?general public licen[cs]e
60 | gpl-2.0 | gpl | gpl ?(?:version |v)?2(?: 0)?
60 | gpl-3.0 | gpl | gpl ?(?:version |v)?3(?: 0)?
60 | lgpl | general public licen | gnu (?:lesser|library) general public licen[cs]e
60 | lgpl-2.1 | lgpl | lgpl ?(?:version |v)?2 1
60 | lgpl-3.0 | lgpl | lgpl ?(?:version |v)?3(?: 0)?
60 | agpl-3.0 | agpl | agpl ?(?:version |v)?3(?: 0)?
60 | isc | isc licen | isc license
60 | lppl | latex project public licen | latex project public license
60 | mit | mit licen | mit license
60 | mit-0 | mit no attribution | mit no attribution license
60 | mpl | mozilla public licen | mozilla public license
60 | ncsa | open source licen | (?:university of illinois )?ncsa open source license
60 | ofl | open font licen | (?:sil )?open font license
60 | osl | open software licen | open software license
60 | php | php licen | php license
60 | postgresql | postgresql licen | postgresql license
60 | unlicense | the unlicense | the unlicense
60 | x11 | x11 licen | x11 license
60 | zlib | licen | zlib(?: libpng)? license
60 | vim | vim licen | vim license
60 | ruby | ruby licen | ruby license
60 | openssl | openssl licen | openssl license
60 | w3c | w3c software | w3c software (?:notice and )?license
60 | curl | curl licen | curl license
50 | public-domain | public domain | (?:dedicated to|released into|placed in|in) the public domain
50 | cc | creative commons | creative commons(?: public)? licen[cs]e
50 | proprietary | all rights reserved | copyright (?:(?!copyright |all rights reserved|\n\s*\n)[\s\S])++all rights reserved
50 | proprietary | licen | proprietary (?:software )?licen[cs]e
50 | commercial | licen | commercial licen[cs]e
50 | non-commercial | licen | non ?commercial (?:use )?licen[cs]e
50 | eula | licen | end user licen[cs]e agreement
50 | dual | licen | dual licen[cs]ed under
"""

#: Words of which one is in each match; a text with none of them, nor with ``SPLIT_GATES``, skips the rules.
GATES = (
    "licen",
    "spdx",
    "gpl",
    "gnu",
    "apache",
    "commons",
    "cc0",
    "cecill",
    "affero",
    "openrail",
    "mozilla",
    "opensource",
    "domain",
    "reserved",
    "contributors",
    "warranty",
    "attribution",
    "permission",
    "redistribution",
    "w3c",
)
#: The same in two words.
SPLIT_GATES = ("cc by", "open rail")


def rules() -> list[tuple[int, str, str, str]]:
    return [
        (int(priority), label, keyword, pattern)
        for priority, label, keyword, pattern in (line.split(" | ") for line in RULES_TEXT.strip().split("\n"))
    ]
