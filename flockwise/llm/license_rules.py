"""Signature rules of `licenses`, written by hand: one a line, in order.

A line is tier, label, gate, keyword and pattern. A pattern is a regular expression over a text's words (lower case, letters, digits
and characters beyond ASCII) with one space between them; a space in it ends a word, and _ stands for any one word. A rule is tried on
texts that hold its gate and its keyword. Tier 1 are SPDX tags (made from the labels below), 2 sentences of a notice, 3 names with a
version or in full, 4 addresses, 5 plain names, 6 hints. Within a tier the earlier line comes first.
"""

from __future__ import annotations

#: How much a detection of each tier says, as the score.
CONFIDENCE = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.8, 5: 0.6, 6: 0.2}

NOTICES = """
2 mit permission granted permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
2 mit permission notice the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software
2 mit-0 permission restriction permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
2 isc permission fee permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
2 0bsd permission fee permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
2 hpnd permission fee permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
2 bsd-2-clause redistribut binary redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided
2 bsd-3-clause redistribut endorse neither the name(?: of)?(?: the)?(?: _){1,8} nor the names of its contributors may be used to endorse or promote products derived from this software
2 bsd-4-clause redistribut advertising all advertising materials mentioning features or use of this software must display the following acknowledge?ment
2 bsd redistribut redistribution redistribution and use in source and binary forms with or without modification are permitted
2 bsd redistribut source redistributions of source code must retain the above copyright notice
2 bsd-3-clause-clear licen patent no express or implied licenses to any party(?: s)? patent rights are granted by this license
2 apache-2.0 licen apache licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
2 apache-2.0 licen basis unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
2 apache-1.1 redistribut apache the end user documentation included with the redistribution if any must include the following acknowledge?ment
2 gpl-2.0-or-later gpl general this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
2 gpl-2.0-or-later licen version gnu general public license as published by the free software foundation either version 2 of the license or(?: at your option)? any later version
2 gpl-3.0-or-later licen version gnu general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
2 gpl-2.0-only licen version gnu general public license version 2 as published by the free software foundation
2 gpl-3.0-only licen version gnu general public license version 3 as published by the free software foundation
2 lgpl-2.1-or-later licen lesser gnu lesser general public license as published by the free software foundation either version 2 1 of the license or(?: at your option)? any later version
2 lgpl-3.0-or-later licen lesser gnu lesser general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
2 lgpl-2.0-or-later licen library gnu library general public license as published by the free software foundation either version 2 of the license or(?: at your option)? any later version
2 agpl-3.0-or-later licen affero gnu affero general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
2 gpl licen received you should have received a copy of the gnu general public license along with
2 lgpl licen received you should have received a copy of the gnu (?:lesser|library) general public license along with
2 agpl licen received you should have received a copy of the gnu affero general public license along with
2 gfdl-1.3 permission documentation permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3
2 gfdl-1.2 permission documentation permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2
2 gfdl-1.1 permission documentation permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 1
2 mpl-2.0 licen mozilla this source code form is subject to the terms of the mozilla public license v 2 0
2 mpl-1.1 licen mozilla the contents of this file are subject to the mozilla public license version 1 1
2 mpl-1.0 licen mozilla the contents of this file are subject to the mozilla public license version 1 0
2 cddl-1.0 licen cddl the contents of this file are subject to the terms of the common development and distribution license
2 epl-2.0 licen eclipse this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? 2 0
2 epl-1.0 licen eclipse this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
2 unlicense domain unencumbered this is free and unencumbered software released into the public domain
2 zlib permission altered altered source versions must be plainly marked as such and must not be misrepresented as being the original software
2 zlib permission origin the origin of this software must not be misrepresented you must not claim that you wrote the original software
2 bsl-1.0 permission machine unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
2 wtfpl licen fuck you just do what the fuck you want to
2 beerware licen beer the beer ware license revision 42
2 cc0-1.0 domain dedicat the person who associated a work with this deed has dedicated the work to the public domain
2 cc-by-4.0 licen creative this work is licensed under a creative commons attribution 4 0 international license
2 cc-by-sa-4.0 licen creative this work is licensed under a creative commons attribution share ?alike 4 0 international license
2 cc-by-nc-4.0 licen creative this work is licensed under a creative commons attribution non ?commercial 4 0 international license
2 cc-by-nd-4.0 licen creative this work is licensed under a creative commons attribution no ?deriv(?:ative)?s 4 0 international license
2 ofl-1.1 licen font this font software is licensed under the sil open font license version 1 1
2 artistic-2.0 licen artistic you may redistribute it and or modify it under the terms of the artistic license 2 0
2 artistic-1.0-perl licen perl this (?:program|library|module) is free software you can redistribute it and or modify it under the same terms as perl itself
2 openssl redistribut openssl this product includes software developed by the openssl project
2 python-2.0 licen python psf hereby grants licensee a nonexclusive royalty free world wide license
2 postgresql permission postgresql permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
2 unicode-3.0 permission unicode permission is hereby granted free of charge to any person obtaining a copy of data files and any associated documentation
2 ncsa permission illinois redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers
2 bzip2-1.0.6 licen bzip2 this program bzip2 the associated library libbzip2 and all documentation are copyright
2 curl copyright daniel copyright (?:c )?1996 (?:_ )?daniel stenberg
2 libpng-2.0 licen libpng png reference library license version 2
2 vim licen vim there are no restrictions on distributing unmodified copies of vim
2 w3c copyright w3c this software or document includes material copied from or derived from
2 json permission evil the software shall be used for good not evil
2 elastic-2.0 licen elastic you may not provide the software to third parties as a hosted or managed service
2 busl-1.1 licen business the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
2 sspl-1.0 licen service if you make the functionality of the program or a modified version available to third parties as a service
2 commons-clause licen sell the license does not grant to you the right to sell the software
2 proprietary copyright confidential this (?:software|document|file|program) (?:is|contains) (?:_ ){0,4}(?:proprietary|confidential)
2 proprietary permission prohibited (?:reproduction|distribution|copying|use)(?: or (?:reproduction|distribution|copying|disclosure))? without (?:the )?(?:prior |express ){0,2}written permission(?: _){0,8} is (?:strictly )?prohibited
"""

NAMES = """
3 apache-2.0 licen apache apache(?: software)? license(?: version| v)? ?2(?: 0)?
3 apache-2.0 licen asl asl(?: version| v)? ?2 0
3 apache-1.1 licen apache apache(?: software)? license(?: version| v)? ?1 1
3 apache-1.0 licen apache apache(?: software)? license(?: version| v)? ?1 0
3 gpl-3.0 licen general gnu general public license(?: version| v)? ?3(?: 0)?
3 gpl-3.0 gpl gpl gnu gpl(?: version)? v?3(?: 0)?
3 gpl-3.0 gpl gpl gpl ?v?3(?: 0)?
3 gpl-3.0-or-later gpl later gpl ?v?3(?: 0)? or (?:later|newer|any later version)
3 gpl-3.0-or-later licen later gnu general public license(?: version| v)? ?3(?: 0)? or (?:later|newer|at your option|any later version)
3 gpl-3.0-only gpl only gpl ?v?3(?: 0)? only
3 gpl-2.0 licen general gnu general public license(?: version| v)? ?2(?: 0)?
3 gpl-2.0 gpl gpl gnu gpl(?: version)? v?2(?: 0)?
3 gpl-2.0 gpl gpl gpl ?v?2(?: 0)?
3 gpl-2.0-or-later gpl later gpl ?v?2(?: 0)? or (?:later|newer|any later version)
3 gpl-2.0-or-later licen later gnu general public license(?: version| v)? ?2(?: 0)? or (?:later|newer|at your option|any later version)
3 gpl-2.0-only gpl only gpl ?v?2(?: 0)? only
3 gpl-1.0 licen general gnu general public license(?: version| v)? ?1(?: 0)?
3 gpl-2.0-classpath licen classpath general public license(?: _){0,6} with(?: the)? classpath exception
3 lgpl-3.0 licen lesser gnu lesser general public license(?: version| v)? ?3(?: 0)?
3 lgpl-3.0 gpl lgpl lgpl ?v?3(?: 0)?
3 lgpl-3.0-or-later gpl lgpl lgpl ?v?3(?: 0)? or (?:later|newer|any later version)
3 lgpl-2.1 licen lesser gnu lesser general public license(?: version| v)? ?2 1
3 lgpl-2.1 gpl lgpl lgpl ?v?2 1
3 lgpl-2.1-or-later gpl lgpl lgpl ?v?2 1 or (?:later|newer|any later version)
3 lgpl-2.0 licen library gnu library general public license(?: version| v)? ?2(?: 0)?
3 lgpl-2.0 gpl lgpl lgpl ?v?2 0
3 agpl-3.0 licen affero gnu affero general public license(?: version| v)? ?3(?: 0)?
3 agpl-3.0 gpl agpl agpl ?v?3(?: 0)?
3 agpl-3.0-or-later gpl agpl agpl ?v?3(?: 0)? or (?:later|newer|any later version)
3 agpl-1.0 licen affero affero general public license(?: version| v)? ?1(?: 0)?
3 gfdl-1.3 licen documentation gnu free documentation license(?: version| v)? ?1 3
3 gfdl-1.2 licen documentation gnu free documentation license(?: version| v)? ?1 2
3 gfdl-1.1 licen documentation gnu free documentation license(?: version| v)? ?1 1
3 mpl-2.0 licen mozilla mozilla public license(?: version| v)? ?2(?: 0)?
3 mpl-2.0 licen mpl mpl(?: version| v)? ?2(?: 0)?
3 mpl-1.1 licen mozilla mozilla public license(?: version| v)? ?1 1
3 mpl-1.1 licen mpl mpl(?: version| v)? ?1 1
3 mpl-1.0 licen mozilla mozilla public license(?: version| v)? ?1 0
3 epl-2.0 licen eclipse eclipse public license(?: version| v)? ?2(?: 0)?
3 epl-1.0 licen eclipse eclipse public license(?: version| v)? ?1(?: 0)?
3 edl-1.0 licen eclipse eclipse distribution license(?: version| v)? ?1(?: 0)?
3 cddl-1.1 licen development common development and distribution license(?: version| v)? ?1 1
3 cddl-1.0 licen development common development and distribution license(?: version| v)? ?1 0
3 cpl-1.0 licen common common public license(?: version| v)? ?1(?: 0)?
3 ipl-1.0 licen ibm ibm public license(?: version| v)? ?1(?: 0)?
3 eupl-1.2 licen european european union public licen[cs]e(?: version| v)? ?1 2
3 eupl-1.1 licen european european union public licen[cs]e(?: version| v)? ?1 1
3 eupl-1.2 licen eupl eupl(?: version| v)? ?1 2
3 cecill-2.1 licen cecill cecill(?: free software license agreement)?(?: version| v)? ?2 1
3 cecill-2.0 licen cecill cecill(?: free software license agreement)?(?: version| v)? ?2(?: 0)?
3 cecill-b licen cecill cecill b
3 cecill-c licen cecill cecill c
3 bsd-2-clause licen bsd (?:2|two) clause bsd(?: license)?
3 bsd-2-clause licen bsd bsd (?:2|two) clause(?: license)?
3 bsd-2-clause licen simplified simplified bsd license
3 bsd-2-clause licen freebsd freebsd license
3 bsd-3-clause licen bsd (?:3|three) clause bsd(?: license)?
3 bsd-3-clause licen bsd bsd (?:3|three) clause(?: license)?
3 bsd-3-clause licen revised (?:new|revised|modified) bsd license
3 bsd-4-clause licen bsd (?:4|four) clause bsd(?: license)?
3 bsd-4-clause licen bsd (?:original|old) bsd license
3 0bsd licen bsd (?:0|zero) clause bsd(?: license)?
3 bsl-1.0 licen boost boost software license(?: version| v)? ?1(?: 0)?
3 artistic-2.0 licen artistic artistic license(?: version| v)? ?2(?: 0)?
3 artistic-1.0 licen artistic artistic license(?: version| v)? ?1(?: 0)?
3 ofl-1.1 licen font sil open font license(?: version| v)? ?1 1
3 ofl-1.0 licen font sil open font license(?: version| v)? ?1 0
3 zpl-2.1 licen zope zope public license(?: version| v)? ?2 1
3 zpl-2.0 licen zope zope public license(?: version| v)? ?2 0
3 php-3.01 licen php php license(?: version| v)? ?3 01
3 php-3.0 licen php php license(?: version| v)? ?3 0
3 python-2.0 licen python python(?: software foundation)? license(?: version| v)? ?2(?: 0)?
3 afl-3.0 licen academic academic free license(?: version| v)? ?3(?: 0)?
3 afl-2.1 licen academic academic free license(?: version| v)? ?2 1
3 osl-3.0 licen open open software license(?: version| v)? ?3(?: 0)?
3 osl-2.1 licen open open software license(?: version| v)? ?2 1
3 ecl-2.0 licen educational educational community license(?: version| v)? ?2(?: 0)?
3 ms-pl licen microsoft microsoft public license
3 ms-rl licen microsoft microsoft reciprocal license
3 lppl-1.3c licen latex latex project public license(?: version| v)? ?1 3c?
3 upl-1.0 licen universal universal permissive license(?: version| v)? ?1(?: 0)?
3 mulan-psl-2.0 licen mulan mulan(?: permissive software license| psl)(?: version| v)? ?2
3 odbl-1.0 licen database open (?:data commons open )?database license(?: odbl)?(?: version| v)? ?1(?: 0)?
3 odc-by-1.0 licen attribution open data commons attribution license(?: version| v)? ?1(?: 0)?
3 pddl-1.0 licen dedication (?:open data commons )?public domain dedication (?:and )?license
3 cdla-permissive-2.0 licen community community data license agreement permissive(?: version| v)? ?2(?: 0)?
3 cdla-sharing-1.0 licen community community data license agreement sharing(?: version| v)? ?1(?: 0)?
3 openrail licen openrail (?:(?:creativeml|bigscience|bigcode) )?open ?rail(?: m)?(?: license)?
3 elastic-2.0 licen elastic elastic license(?: version| v)? ?2(?: 0)?
3 busl-1.1 licen business business source license(?: version| v)? ?1 1
3 sspl-1.0 licen server server side public license(?: version| v)? ?1?
3 cc0-1.0 cc zero cc ?zero(?: 1 0)?(?: universal)?
3 cc0-1.0 cc0 cc0 cc0(?: 1 0)?(?: universal)?
3 cc-by-4.0 cc by cc by(?: version| v)? ?4 0
3 cc-by-3.0 cc by cc by(?: version| v)? ?3 0
3 cc-by-2.5 cc by cc by(?: version| v)? ?2 5
3 cc-by-2.0 cc by cc by(?: version| v)? ?2 0
3 cc-by-sa-4.0 cc by cc by sa(?: version| v)? ?4 0
3 cc-by-sa-3.0 cc by cc by sa(?: version| v)? ?3 0
3 cc-by-sa-2.5 cc by cc by sa(?: version| v)? ?2 5
3 cc-by-nc-4.0 cc by cc by nc(?: version| v)? ?4(?: 0)?
3 cc-by-nc-3.0 cc by cc by nc(?: version| v)? ?3(?: 0)?
3 cc-by-nc-2.0 cc by cc by nc(?: version| v)? ?2(?: 0)?
3 cc-by-nc-sa-4.0 cc by cc by nc sa(?: version| v)? ?4(?: 0)?
3 cc-by-nc-sa-3.0 cc by cc by nc sa(?: version| v)? ?3(?: 0)?
3 cc-by-nc-nd-4.0 cc by cc by nc nd(?: version| v)? ?4(?: 0)?
3 cc-by-nc-nd-3.0 cc by cc by nc nd(?: version| v)? ?3(?: 0)?
3 cc-by-nd-4.0 cc by cc by nd(?: version| v)? ?4(?: 0)?
3 cc-by-nd-3.0 cc by cc by nd(?: version| v)? ?3(?: 0)?
3 cc-by-4.0 commons attribution creative commons attribution 4 0(?: international)?
3 cc-by-3.0 commons attribution creative commons attribution 3 0(?: unported)?
3 cc-by-sa-4.0 commons attribution creative commons attribution share ?alike 4 0(?: international)?
3 cc-by-sa-3.0 commons attribution creative commons attribution share ?alike 3 0(?: unported)?
3 cc-by-nc-4.0 commons attribution creative commons attribution non ?commercial 4 0(?: international)?
3 cc-by-nc-sa-4.0 commons attribution creative commons attribution non ?commercial share ?alike 4 0(?: international)?
3 cc-by-nc-nd-4.0 commons attribution creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?
3 cc-by-nd-4.0 commons attribution creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?
3 cc0-1.0 commons zero creative commons zero(?: v?1 0)?(?: universal)?
"""

ADDRESSES = """
4 mit licen opensource opensource org licenses? mit(?: license)?(?: php| html)?
4 isc licen opensource opensource org licenses? isc(?: license)?
4 apache-2.0 licen apache apache org licenses license 2 0(?: txt| html)?
4 apache-2.0 licen opensource opensource org licenses? apache 2 0
4 apache-1.1 licen apache apache org licenses license 1 1
4 bsd-2-clause licen opensource opensource org licenses? bsd 2 clause
4 bsd-3-clause licen opensource opensource org licenses? bsd 3 clause
4 bsd licen opensource opensource org licenses? bsd license
4 gpl-3.0 licen gnu gnu org licenses gpl 3 0
4 gpl-2.0 licen gnu gnu org licenses(?: old licenses)? gpl 2 0
4 gpl licen gnu gnu org (?:copyleft|licenses) gpl
4 lgpl-3.0 licen gnu gnu org licenses lgpl 3 0
4 lgpl-2.1 licen gnu gnu org licenses(?: old licenses)? lgpl 2 1
4 lgpl licen gnu gnu org (?:copyleft|licenses) lgpl
4 agpl-3.0 licen gnu gnu org licenses agpl 3 0
4 gfdl licen gnu gnu org (?:copyleft|licenses) fdl
4 mpl-2.0 licen mozilla mozilla org mpl 2 0
4 mpl-2.0 licen mozilla mozilla org en us mpl 2 0
4 mpl-1.1 licen mozilla mozilla org mpl mpl 1 1
4 epl-2.0 licen eclipse eclipse org legal epl 2 0
4 epl-1.0 licen eclipse eclipse org legal epl v10
4 bsl-1.0 licen boost boost org license 1 0(?: txt)?
4 unlicense licen unlicense unlicense org
4 wtfpl licen wtfpl wtfpl net
4 ofl-1.1 licen sil scripts sil org ofl
4 cc-by-4.0 commons by creativecommons org licenses by 4 0
4 cc-by-3.0 commons by creativecommons org licenses by 3 0
4 cc-by-2.0 commons by creativecommons org licenses by 2 0
4 cc-by-sa-4.0 commons sa creativecommons org licenses by sa 4 0
4 cc-by-sa-3.0 commons sa creativecommons org licenses by sa 3 0
4 cc-by-nc-4.0 commons nc creativecommons org licenses by nc 4 0
4 cc-by-nc-3.0 commons nc creativecommons org licenses by nc 3 0
4 cc-by-nc-sa-4.0 commons nc creativecommons org licenses by nc sa 4 0
4 cc-by-nc-nd-4.0 commons nc creativecommons org licenses by nc nd 4 0
4 cc-by-nd-4.0 commons nd creativecommons org licenses by nd 4 0
4 cc0-1.0 commons zero creativecommons org publicdomain zero 1 0
4 public-domain commons mark creativecommons org publicdomain mark 1 0
4 odbl-1.0 licen opendatacommons opendatacommons org licenses odbl
4 artistic-2.0 licen perlfoundation perlfoundation org artistic license 2 0
4 eupl-1.2 licen eupl joinup ec europa eu(?: _){0,3} eupl
4 polyform licen polyform polyformproject org licenses
"""

PLAIN = """
5 mit licen mit mit licen[cs]ed?
5 mit licen expat expat license
5 mit licen x11 (?:mit x11|x11) license
5 mit licen mit licensed under(?: the)?(?: terms of the)? mit
5 apache licen apache apache(?: software)? license
5 apache licen apache licensed under(?: the)? apache
5 gpl licen general (?:gnu )?general public license
5 gpl gpl gpl (?:gnu )?gpl(?:ed)?
5 lgpl licen general (?:gnu )?(?:lesser|library) general public license
5 lgpl gpl lgpl (?:gnu )?lgpl
5 agpl licen affero (?:gnu )?affero general public license
5 agpl gpl agpl (?:gnu )?agpl
5 gfdl licen documentation (?:gnu )?free documentation license
5 bsd licen bsd bsd(?: style)? licen[cs]ed?
5 isc licen isc isc license
5 mpl licen mozilla mozilla public license
5 epl licen eclipse eclipse public license
5 cddl licen development common development and distribution license
5 zlib licen zlib zlib(?: libpng)? license
5 bsl licen boost boost software license
5 artistic licen artistic artistic license
5 ofl licen font (?:sil )?open font license
5 php licen php php license
5 python licen python python(?: software foundation)? license
5 unlicense licen unlicense the unlicense
5 wtfpl licen wtfpl wtfpl(?: license)?
5 beerware licen beer beer ?ware license
5 eupl licen european european union public licen[cs]e
5 cecill licen cecill cecill
5 ncsa licen illinois university of illinois(?: ncsa)? open source license
5 postgresql licen postgresql postgresql license
5 openssl licen openssl openssl license
5 vim licen vim vim license
5 zpl licen zope zope public license
5 afl licen academic academic free license
5 osl licen open open software license
5 odbl licen database open database license
5 elastic licen elastic elastic license
5 busl licen business business source license
5 sspl licen server server side public license
5 openrail licen rail (?:responsible ai|open rail) license
5 llama licen llama llama(?: _){0,2} community license
5 cc-by-nc-sa cc by cc by nc sa
5 cc-by-nc-nd cc by cc by nc nd
5 cc-by-nc cc by cc by nc
5 cc-by-nd cc by cc by nd
5 cc-by-sa cc by cc by sa
5 cc-by cc by cc by
5 cc commons creative creative commons(?: _){0,3} licen[cs]e
5 public-domain domain public (?:in|into|to) the public domain
5 public-domain domain public public domain (?:dedication|work|mark)
5 commercial licen commercial commercial licen[cs]e(?: agreement)?
5 eula licen end end user licen[cs]e agreement
"""

HINTS = """
6 all-rights-reserved copyright rights copyright(?: _){0,12} all rights reserved
6 copyright copyright copyright copyright (?:c )?(?:19|20)[0-9][0-9]
6 free-license licen under (?:licensed|released|distributed) under (?:an?|the) (?:_ ){0,2}(?:free|open|permissive) (?:_ ){0,2}licen[cs]e
6 unknown-license licen under (?:licensed|released|distributed|available) under(?: the)?(?: terms of)?(?: the)?(?: _){0,3} licen[cs]e
6 unknown-license licen see see(?: the)? licen[cs]e(?: file| txt| md)? for
6 unknown-license licen file licen[cs]e file
"""


def rules() -> list[tuple[int, int, str, str, str, str]]:
    """(number, tier, label, gate, keyword, pattern over words), SPDX tags of all labels with a version or clause first."""
    lines = [x.split(" ", 4) for part in (NOTICES, NAMES, ADDRESSES, PLAIN, HINTS) for x in part.strip().splitlines()]
    labels = sorted({x[1] for x in lines if int(x[0]) < 5} - {"proprietary", "public-domain", "polyform"})
    tags = [["1", x, "spdx", x.split("-")[0].split(".")[0], "spdx license identifier " + x.replace("-", " ").replace(".", " ")] for x in labels]
    return [(i, int(tier), label, gate, key, pattern) for i, (tier, label, gate, key, pattern) in enumerate(tags + lines)]
