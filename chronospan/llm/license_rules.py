"""Hand-written rules of the license scan.

A rule: label | priority | relevance | pattern over words | keywords.  Keywords
are groups between spaces, alternatives within a group between slashes: each
text that the pattern matches has a word of each group.
"""

from __future__ import annotations

# Sentences of licence texts.
TEXTS = """
mit | 85 | 1.0 | permission is hereby granted free of charge to any person obtaining a copy | hereby granted
mit | 84 | 1.0 | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense | sublicense restriction
mit | 60 | 0.9 | the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions | substantial portions
mit-advertising | 86 | 1.0 | except as contained in this notice the names? of .{1,80}? shall not be used in advertising or otherwise to promote | advertising promote
mit-warranty | 58 | 0.7 | in no event shall the authors or copyright holders be liable for any claim damages or other liability | holders liable
mit-warranty | 57 | 0.7 | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability | merchantability warranty
isc | 85 | 1.0 | permission to use copy modify and or distribute this software for any purpose with or without fee | permission fee
isc | 84 | 1.0 | the author disclaims all warranties with regard to this software | disclaims regard
hpnd | 83 | 1.0 | permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted | documentation fee
ntp | 83 | 1.0 | provided that the above copyright notice appears in all copies and that both (?:that|the) copyright notice and this permission notice appear in supporting documentation | appears supporting
bsd | 60 | 0.9 | redistribution and use in source and binary forms with or without modification are permitted | redistribution binary
bsd | 59 | 0.8 | redistributions of source code must retain the above copyright notice this list of conditions | redistributions retain
bsd | 59 | 0.8 | redistributions in binary form must reproduce the above copyright notice this list of conditions | redistributions reproduce
bsd-3-clause | 85 | 1.0 | neither the names? of .{1,80}? nor the names of (?:its|their|any) contributors may be used to endorse | endorse contributors
bsd-3-clause | 84 | 1.0 | the names? of .{1,60}? may not be used to endorse or promote products derived from this software | endorse derived
bsd-4-clause | 86 | 1.0 | all advertising materials mentioning features or use of this software must display | advertising materials
bsd-4-clause | 85 | 1.0 | this product includes software developed by the university of california berkeley and its contributors | berkeley developed
bsd-patent | 86 | 1.0 | each copyright holder and contributor hereby grants to recipients of this software a perpetual worldwide | recipients perpetual
bsd-1-clause | 84 | 0.9 | redistributions of source code must retain the above copyright notice this condition and the following disclaimer | redistributions condition
bsd-clear | 86 | 1.0 | no express or implied licen[cs]es to any party s patent rights are granted by this licen[cs]e | patent party
bsd-warranty | 57 | 0.7 | this software is provided by (?:the )?(?:copyright holders and contributors|authors?|regents and contributors|.{1,40}?) as is and any express or implied warranties | warranties express
bsd-warranty | 56 | 0.7 | in no event shall .{1,80}? be liable for any direct indirect incidental special exemplary or consequential damages | exemplary consequential
apache-2.0 | 85 | 1.0 | you may not use this file except in compliance with the licen[cs]e | compliance file
apache-2.0 | 60 | 0.9 | unless required by applicable law or agreed to in writing software distributed under the licen[cs]e | applicable writing
apache-2.0 | 84 | 1.0 | terms and conditions for use reproduction and distribution | reproduction conditions
apache-2.0 | 84 | 1.0 | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) licen[cs]e | irrevocable royalty
apache-2.0 | 82 | 0.95 | you must give any other recipients of the work or derivative works a copy of this licen[cs]e | recipients derivative
apache-2.0 | 82 | 0.95 | if the work includes a notice text file as part of its distribution | notice distribution
apache-1.1 | 85 | 1.0 | this product includes software developed by the apache software foundation | apache developed
apache-1.1 | 85 | 1.0 | products derived from this software may not be called apache nor may apache appear in their name | apache called
asf-header | 80 | 0.9 | licen[cs]ed to the apache software foundation asf under one or more contributor licen[cs]e agreements | asf contributor
gpl | 60 | 0.9 | this (?:program|library|file|software) is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e | redistribute gnu
gpl | 58 | 0.8 | you should have received a copy of the gnu general public licen[cs]e | received gnu
gpl | 57 | 0.7 | is distributed in the hope that it will be useful but without any warranty | hope useful
gpl | 56 | 0.7 | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[cs]e | fitness gnu
gpl-2.0 | 84 | 1.0 | gnu general public licen[cs]e version 2 june 1991 | june 1991
gpl-3.0 | 84 | 1.0 | gnu general public licen[cs]e version 3 29 june 2007 | june 2007
gpl-1.0 | 84 | 1.0 | gnu general public licen[cs]e version 1 february 1989 | february 1989
gpl-2.0 | 82 | 0.95 | the licen[cs]es for most software are designed to take away your freedom to share and change it | designed freedom
gpl-2.0 | 82 | 0.95 | you may copy and distribute verbatim copies of the program s source code as you receive it | verbatim program
gpl-3.0 | 82 | 0.95 | the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works | copyleft kinds
gpl-3.0 | 82 | 0.95 | when you convey a covered work you waive any legal power to forbid circumvention of technological measures | convey circumvention
gpl-or-later | 62 | 0.9 | either version [123] of the licen[cs]e or (?:at your option )?any later version | either later
gpl-or-later | 61 | 0.8 | version [123](?: 0)? (?:of the gnu general public licen[cs]e )?or (?:at your option )?(?:any )?later | version later
gpl-only | 62 | 0.9 | under the terms of version [123] (?:only )?of the gnu general public licen[cs]e | terms gnu
lgpl | 60 | 0.9 | under the terms of the gnu (?:lesser|library) general public licen[cs]e | lesser/library gnu
lgpl | 58 | 0.8 | you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e | lesser/library received
lgpl-2.1 | 84 | 1.0 | gnu lesser general public licen[cs]e version 2 1 february 1999 | february 1999
lgpl-2.0 | 84 | 1.0 | gnu library general public licen[cs]e version 2 june 1991 | library 1991
lgpl-3.0 | 84 | 1.0 | gnu lesser general public licen[cs]e version 3 29 june 2007 | lesser 2007
lgpl-3.0 | 82 | 0.95 | incorporates the terms and conditions of version 3 of the gnu general public licen[cs]e supplemented by the additional permissions | incorporates supplemented
agpl | 60 | 0.9 | under the terms of the gnu affero general public licen[cs]e | affero gnu
agpl | 58 | 0.8 | you should have received a copy of the gnu affero general public licen[cs]e | affero received
agpl-3.0 | 84 | 1.0 | gnu affero general public licen[cs]e version 3 19 november 2007 | affero november
agpl-3.0 | 82 | 0.95 | your modified version must prominently offer all users interacting with it remotely through a computer network | prominently remotely
gfdl | 84 | 1.0 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e | documentation document
gfdl | 82 | 0.95 | with no invariant sections no front cover texts and no back cover texts | invariant cover
mpl-2.0 | 85 | 1.0 | this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0 | mozilla subject
mpl-2.0 | 84 | 1.0 | if a copy of the mpl was not distributed with this file you can obtain one at | mpl obtain
mpl-1.1 | 85 | 1.0 | the contents of this file are subject to the mozilla public licen[cs]e version 1 1 | mozilla contents
mpl-1.0 | 85 | 1.0 | the contents of this file are subject to the mozilla public licen[cs]e version 1 0 | mozilla contents
npl | 85 | 1.0 | the contents of this file are subject to the netscape public licen[cs]e | netscape contents
mpl-tri | 83 | 0.95 | alternatively the contents of this file may be used under the terms of either the gnu general public licen[cs]e | alternatively either
epl-1.0 | 84 | 1.0 | the accompanying program is provided under the terms of this eclipse public licen[cs]e | eclipse accompanying
epl | 83 | 1.0 | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e | eclipse materials
epl-2.0 | 83 | 0.95 | this source code may also be made available under the following secondary licen[cs]es when the conditions | secondary conditions
cddl-1.0 | 84 | 1.0 | the contents of this file are subject to the terms of the common development and distribution licen[cs]e | development contents
cddl-1.0 | 82 | 0.95 | when distributing covered code include this cddl header in each file | cddl header
cpl-1.0 | 84 | 1.0 | the accompanying program is provided under the terms of this common public licen[cs]e | common accompanying
eupl | 84 | 1.0 | licen[cs]ed under the eupl(?: version)? 1 [12] or as soon they will be approved by the european commission | eupl commission
artistic-1.0 | 84 | 1.0 | the intent of this document is to state the conditions under which a package may be copied | intent package
artistic-2.0 | 84 | 1.0 | everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed preamble this licen[cs]e establishes the terms under which a given free software package | establishes package
perl | 83 | 1.0 | (?:you can redistribute it and or modify it|this (?:module|library|program) is free software(?: you can redistribute it and or modify it)?) under the same terms as perl itself | perl itself
zlib | 85 | 1.0 | this software is provided as is without any express or implied warranty in no event will the authors | event authors
zlib | 84 | 1.0 | the origin of this software must not be misrepresented you must not claim that you wrote the original software | misrepresented wrote
zlib | 82 | 0.95 | altered source versions must be plainly marked as such and must not be misrepresented | altered plainly
libpng | 84 | 1.0 | the png reference library is supplied as is | png supplied
ijg | 84 | 1.0 | this software is based in part on the work of the independent jpeg group | jpeg independent
freetype | 84 | 1.0 | portions of this software are copyright .{1,40}? the freetype project | freetype portions
boost | 85 | 1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy | hereby organization
boost | 84 | 1.0 | unless such copies or derivative works are solely in the form of machine executable object code | solely executable
unlicense | 85 | 1.0 | this is free and unencumbered software released into the public domain | unencumbered domain
unlicense | 84 | 1.0 | anyone is free to copy modify publish use compile sell or distribute this software | compile sell
cc0-1.0 | 84 | 1.0 | to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights | waived neighboring
cc0-1.0 | 84 | 1.0 | affirmer hereby overtly fully permanently irrevocably and unconditionally waives | affirmer waives
wtfpl | 85 | 1.0 | you just do what the fuck you want to | fuck want
beerware | 85 | 1.0 | as long as you retain this notice you can do whatever you want with this stuff | retain stuff
beerware | 84 | 1.0 | if we meet some day and you think this stuff is worth it you can buy me a beer | beer worth
json | 85 | 1.0 | the software shall be used for good not evil | good evil
postgresql | 84 | 1.0 | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement | written agreement
ncsa | 84 | 1.0 | developed by .{1,80}? permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction | developed associated
python-2.0 | 84 | 1.0 | this licen[cs]e agreement is between the python software foundation psf and the individual or organization | psf agreement
python-cnri | 84 | 1.0 | this licen[cs]e agreement is between the corporation for national research initiatives | initiatives corporation
php | 84 | 1.0 | this product includes php software freely available from | php freely
openssl | 85 | 1.0 | this product includes software developed by the openssl project for use in the openssl toolkit | openssl toolkit
ssleay | 85 | 1.0 | this package is an ssl implementation written by eric young | ssl eric
x11 | 84 | 1.0 | except as contained in this notice the name of the x consortium shall not be used in advertising | consortium advertising
xfree86 | 84 | 1.0 | this product includes software developed by the xfree86 project | xfree86 developed
w3c | 84 | 1.0 | permission to copy modify and distribute this software and its documentation with or without modification for any purpose and without fee or royalty is hereby granted | royalty documentation
unicode | 84 | 1.0 | permission is hereby granted free of charge to any person obtaining a copy of (?:the )?(?:unicode )?data files and any associated documentation | data associated
ofl-1.1 | 84 | 1.0 | this font software is licen[cs]ed under the sil open font licen[cs]e | sil font
ofl-1.1 | 83 | 0.95 | the goals of the open font licen[cs]e ofl are to stimulate worldwide development of collaborative font projects | ofl collaborative
ofl-1.1 | 82 | 0.9 | with reserved font name | reserved font
bitstream-vera | 84 | 1.0 | the fonts? (?:software )?(?:may be|names?) .{0,60}?bitstream (?:or the word )?vera | bitstream vera
ms-pl | 84 | 1.0 | this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e | governs accompanying
upl-1.0 | 84 | 1.0 | subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software | condition forth
ecl-2.0 | 83 | 0.95 | licen[cs]ed under the educational community licen[cs]e version 2 0 | educational community
osl | 83 | 0.95 | licen[cs]ed under the open software licen[cs]e version [123] 0 | open version
afl | 83 | 0.95 | licen[cs]ed under the academic free licen[cs]e version [123] [012] | academic free
qpl | 84 | 1.0 | you may distribute your modifications in a form that is separate from the software such as patches | separate patches
sleepycat | 84 | 1.0 | redistributions in any form must be accompanied by information on how to obtain complete source code | redistributions accompanied
vim | 84 | 1.0 | vim is charityware you can use and copy it as much as you like | charityware vim
curl | 84 | 1.0 | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is without warranty | appear fee
icu | 83 | 0.9 | provided that the above copyright notice s and this permission notice appear in all copies of the software | notice copies
tcl | 84 | 1.0 | the authors hereby grant permission to use copy modify distribute and licen[cs]e this software and its documentation | hereby grant
zpl | 84 | 1.0 | zope public licen[cs]e zpl version [12] [01] | zope zpl
cecill | 84 | 1.0 | this software is governed by the cecill(?: [abc])? licen[cs]e under french law | cecill governed
lppl | 84 | 1.0 | this work may be distributed and or modified under the conditions of the latex project public licen[cs]e | latex conditions
odbl-1.0 | 84 | 1.0 | this database is made available under the open database licen[cs]e | database available
odbl-1.0 | 82 | 0.9 | any rights in individual contents of the database are licen[cs]ed under the database contents licen[cs]e | database individual
ogl-uk | 84 | 1.0 | contains public sector information licen[cs]ed under the open government licen[cs]e | sector government
etalab | 84 | 1.0 | licence ouverte(?: open licence)?(?: version)?(?: [12] 0)? | licence ouverte
dl-de | 84 | 1.0 | datenlizenz deutschland (?:namensnennung|zero)(?: version)? 2 0 | datenlizenz deutschland
"""

# Notices, references, addresses, exceptions and terms.
NOTICES = """
apache-2.0 | 78 | 0.95 | (?:http|https) (?:www )?apache org licen[cs]es licen[cs]e 2 0 | apache org
apache-2.0 | 70 | 0.9 | opensource org licen[cs]es apache 2 0 | opensource apache
mit | 78 | 0.95 | opensource org licen[cs]es mit(?: licen[cs]e)? | opensource mit
mit | 72 | 0.9 | (?:mit|expat) licen[cs]ed | mit/expat licensed/licenced
mit | 71 | 0.9 | choosealicense com licen[cs]es mit | choosealicense mit
bsd | 78 | 0.9 | opensource org licen[cs]es bsd(?: licen[cs]e)? | opensource bsd
bsd | 71 | 0.9 | (?:a |the )?bsd style licen[cs]e | bsd style
bsd | 50 | 0.8 | bsd licen[cs]ed | bsd licensed/licenced
bsd-3-clause | 78 | 0.95 | opensource org licen[cs]es bsd 3 clause | opensource clause
bsd-2-clause | 78 | 0.95 | opensource org licen[cs]es bsd 2 clause | opensource clause
isc | 78 | 0.95 | opensource org licen[cs]es isc | opensource isc
gpl | 78 | 0.95 | (?:http|https) (?:www )?gnu org (?:licen[cs]es|copyleft) gpl(?: html)? | gnu gpl
gpl-2.0 | 79 | 0.95 | gnu org licen[cs]es (?:old licen[cs]es )?gpl 2 0 | gnu gpl
gpl-3.0 | 79 | 0.95 | gnu org licen[cs]es gpl 3 0 | gnu gpl
lgpl | 78 | 0.95 | gnu org (?:licen[cs]es|copyleft) lgpl(?: html)? | gnu lgpl
lgpl-2.1 | 79 | 0.95 | gnu org licen[cs]es (?:old licen[cs]es )?lgpl 2 1 | gnu lgpl
agpl-3.0 | 79 | 0.95 | gnu org licen[cs]es agpl(?: 3 0)? | gnu agpl
gfdl | 78 | 0.95 | gnu org (?:licen[cs]es|copyleft) fdl(?: 1 [123])? | gnu fdl
mpl-2.0 | 78 | 0.95 | mozilla org (?:en us )?mpl 2 0 | mozilla mpl
mpl | 77 | 0.9 | mozilla org mpl(?: mpl 1 1)? | mozilla mpl
epl | 78 | 0.95 | eclipse org (?:legal|org documents) epl (?:v10|v20|2 0) | eclipse legal/documents
boost | 78 | 0.95 | boost org licen[cs]e 1 0 txt | boost txt
unlicense | 78 | 0.95 | unlicense org | unlicense org
zlib | 78 | 0.95 | opensource org licen[cs]es zlib | opensource zlib
cc0-1.0 | 78 | 0.95 | creativecommons org publicdomain zero 1 0 | creativecommons zero
cc-pdm | 78 | 0.95 | creativecommons org publicdomain mark 1 0 | creativecommons mark
cc-by | 76 | 0.9 | creativecommons org licen[cs]es by [1234] [05] | creativecommons by
cc-by-sa | 77 | 0.9 | creativecommons org licen[cs]es by sa [1234] [05] | creativecommons sa
cc-by-nc | 77 | 0.9 | creativecommons org licen[cs]es by nc [1234] [05] | creativecommons nc
cc-by-nd | 77 | 0.9 | creativecommons org licen[cs]es by nd [1234] [05] | creativecommons nd
cc-by-nc-sa | 78 | 0.9 | creativecommons org licen[cs]es by nc sa [1234] [05] | creativecommons sa
cc-by-nc-nd | 78 | 0.9 | creativecommons org licen[cs]es by nc nd [1234] [05] | creativecommons nd
cc | 50 | 0.8 | this (?:work|article|image|document|page) is (?:distributed |licen[cs]ed |available )?under (?:a|the) creative commons | creative commons
cc | 49 | 0.7 | under a creative commons | creative commons
cc-by | 52 | 0.85 | creative commons attribution(?: [1234] 0)?(?: (?:international|generic|unported))? licen[cs]e | creative attribution
cc-by-sa | 54 | 0.85 | creative commons attribution share ?alike(?: [1234] 0)?(?: (?:international|generic|unported))?(?: licen[cs]e)? | creative attribution
cc-by-nc | 54 | 0.85 | creative commons attribution non ?commercial(?: [1234] 0)?(?: (?:international|generic|unported))?(?: licen[cs]e)? | creative attribution
cc-by-nc-sa | 56 | 0.85 | creative commons attribution non ?commercial share ?alike(?: [1234] 0)?(?: (?:international|generic|unported))?(?: licen[cs]e)? | creative attribution
cc-by-nc-nd | 56 | 0.85 | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1234] 0)?(?: (?:international|generic|unported))?(?: licen[cs]e)? | creative attribution
cc-by-nd | 54 | 0.85 | creative commons attribution no ?deriv(?:ative)?s(?: [1234] 0)?(?: (?:international|generic|unported))?(?: licen[cs]e)? | creative attribution
ofl-1.1 | 78 | 0.95 | scripts sil org ofl | sil ofl
odbl-1.0 | 78 | 0.95 | opendatacommons org licen[cs]es odbl | opendatacommons odbl
odc-by-1.0 | 78 | 0.95 | opendatacommons org licen[cs]es by | opendatacommons by
pddl-1.0 | 78 | 0.95 | opendatacommons org licen[cs]es pddl | opendatacommons pddl
openstreetmap | 70 | 0.9 | openstreetmap contributors | openstreetmap contributors
wikipedia | 60 | 0.8 | text is available under the creative commons attribution share ?alike licen[cs]e | text creative
perl | 70 | 0.9 | same licen[cs]e as perl(?: itself)? | same perl
ruby | 70 | 0.9 | under the same terms as ruby | same ruby
dual-mit-apache | 82 | 0.95 | (?:dual )?licen[cs]ed under (?:either of )?(?:the )?(?:apache licen[cs]e(?: version)? 2 0 (?:or|and) (?:the )?mit|mit (?:or|and) (?:the )?apache) | mit apache
dual-mit-gpl | 82 | 0.95 | (?:dual )?licen[cs]ed under (?:the )?(?:mit (?:or|and) gpl|gpl (?:or|and) mit) | mit gpl
dual-license | 65 | 0.8 | (?:is |are )?dual licen[cs]ed | dual licensed/licenced
gpl-linking | 74 | 0.9 | as a special exception (?:to the gnu general public licen[cs]e )?(?:the copyright holders? |you may |if )(?:of this .{1,40}? )?(?:gives? you permission to |have permission to )?link | special exception
classpath-exception | 80 | 0.95 | classpath exception(?: 2 0)? | classpath exception
classpath-exception | 82 | 1.0 | linking this library statically or dynamically with other modules is making a combined work | statically combined
gcc-exception | 80 | 0.95 | gcc runtime library exception(?: version)?(?: 3 1)? | gcc runtime
autoconf-exception | 80 | 0.95 | this file is part of a program that contains a configuration script generated by autoconf | autoconf configuration
bison-exception | 80 | 0.95 | you may create a larger work that contains part or all of the bison parser skeleton | bison skeleton
font-exception | 80 | 0.95 | embeds? this font or unaltered portions of this font into the document | font unaltered
llvm-exception | 80 | 0.95 | (?:apache 2 0 with llvm exception|llvm exceptions? to the apache 2 0 licen[cs]e) | llvm apache
openssl-exception | 80 | 0.95 | permission to link the code of portions of this program with the openssl library | link openssl
qt-exception | 80 | 0.95 | (?:digia|nokia|the qt company) qt lgpl exception | qt exception
linux-syscall-note | 80 | 0.95 | linux syscall note | linux syscall
public-domain | 50 | 0.8 | (?:released|placed|dedicated|put) (?:in|into|to) the public domain | public domain
public-domain | 48 | 0.8 | (?:is|are) (?:in|now in) the public domain | public domain
public-domain | 49 | 0.8 | public domain dedication | domain dedication
public-domain | 47 | 0.7 | no (?:known )?copyright (?:restrictions|is claimed|protection) | copyright restrictions/claimed/protection
public-domain-us | 52 | 0.85 | work of the (?:united states|u s|us) (?:federal )?government | government work
public-domain-fr | 48 | 0.7 | domaine public | domaine public
public-domain-es | 48 | 0.7 | dominio publico | dominio publico
gemeinfrei | 48 | 0.7 | gemeinfrei(?:e|es|er)? | gemeinfrei/gemeinfreie/gemeinfreies/gemeinfreier
proprietary | 50 | 0.8 | all rights reserved | rights reserved
proprietary | 50 | 0.8 | alle rechte vorbehalten | rechte vorbehalten
proprietary | 50 | 0.8 | tous droits reserves | droits reserves
proprietary | 50 | 0.8 | todos los derechos reservados | derechos reservados
proprietary | 50 | 0.8 | tutti i diritti riservati | diritti riservati
proprietary | 55 | 0.9 | (?:unauthorized|unauthorised) (?:copying|use|reproduction|distribution|duplication) .{0,60}?(?:strictly )?prohibited | prohibited unauthorized/unauthorised
proprietary | 54 | 0.85 | no part of this (?:publication|book|document|work) may be reproduced | reproduced part
proprietary | 54 | 0.85 | (?:may not|must not) be (?:copied|reproduced|distributed|republished) (?:without|except with) (?:the )?(?:prior )?(?:written )?(?:permission|consent) | permission/consent not
proprietary | 54 | 0.85 | without (?:the )?(?:express )?(?:prior )?written (?:permission|consent) of | written without
proprietary | 53 | 0.85 | confidential and proprietary | confidential proprietary
proprietary | 53 | 0.85 | proprietary and confidential | confidential proprietary
proprietary | 52 | 0.8 | trade secrets? of | trade of
proprietary | 52 | 0.8 | for internal use only | internal only
commercial | 55 | 0.85 | (?:a )?commercial licen[cs]e (?:is|can be|may be) (?:required|purchased|obtained|available) | commercial required/purchased/obtained/available
commercial | 54 | 0.85 | contact .{1,40}? for (?:a )?commercial licen[cs]ing | commercial contact
eula | 58 | 0.9 | end user licen[cs]e agreement | end agreement
eula | 57 | 0.85 | by (?:installing|downloading|using|clicking) .{0,60}?you (?:agree|accept|consent) | by you
eula | 56 | 0.85 | (?:you may not|shall not) (?:reverse engineer|decompile|disassemble) | reverse/decompile/disassemble not
freeware | 50 | 0.75 | (?:is |as )freeware | freeware
shareware | 50 | 0.75 | (?:is |as )shareware | shareware
non-commercial | 56 | 0.85 | for (?:personal and )?non ?commercial (?:use|purposes)(?: only)? | for use/purposes
non-commercial | 55 | 0.85 | not for commercial use | commercial not
academic | 55 | 0.85 | for (?:academic|research|educational)(?: and (?:academic|research|educational))? (?:use|purposes) only | academic/research/educational only
evaluation | 55 | 0.85 | for evaluation purposes only | evaluation purposes
open-source | 30 | 0.5 | (?:osi|opensource initiative) approved | approved osi/opensource
copyleft | 30 | 0.5 | copyleft licen[cs]ed? | copyleft
permissive | 30 | 0.5 | permissive(?:ly)? licen[cs]ed? | permissive/permissively
fsf-unlimited | 72 | 0.9 | this file is free software the free software foundation gives unlimited permission | unlimited foundation
fsf-notice | 70 | 0.9 | copying and distribution of this file with or without modification are permitted in any medium without royalty | medium royalty
gnu-all-permissive | 71 | 0.9 | are permitted in any medium without royalty provided the copyright notice and this notice are preserved | preserved royalty
dco | 70 | 0.9 | developer certificate of origin(?: version 1 1)? | certificate origin
cla | 60 | 0.8 | contributor licen[cs]e agreement | contributor agreement
patent-grant | 60 | 0.85 | additional grant of patent rights(?: version 2)? | patent grant
export-notice | 40 | 0.6 | subject to (?:the )?(?:u s |united states )?export (?:control|administration) (?:laws|regulations) | export laws/regulations
trademark | 40 | 0.6 | (?:is|are) (?:a )?(?:registered )?trademarks? of | of trademark/trademarks
khronos | 80 | 0.9 | the khronos group inc permission is hereby granted | khronos permission
nvidia | 78 | 0.9 | nvidia corporation and its licensors retain all intellectual property | nvidia licensors
intel-simplified | 80 | 0.9 | intel simplified software licen[cs]e | intel simplified
oracle-bcl | 80 | 0.9 | oracle binary code licen[cs]e agreement | oracle binary
adobe | 78 | 0.9 | adobe systems incorporated .{0,60}?licen[cs]e | adobe incorporated
llama | 80 | 0.95 | llama (?:[123](?: [0-9])? )?community licen[cs]e(?: agreement)? | llama community
openrail | 80 | 0.95 | (?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[cs]e)? | openrail/open
gemma | 80 | 0.95 | gemma terms of use | gemma terms
commons-clause | 82 | 0.95 | commons clause(?: licen[cs]e condition)?(?: v1 0)? | commons clause
polyform | 80 | 0.95 | polyform (?:noncommercial|shield|strict|perimeter|free trial|small business|internal use) licen[cs]e | polyform
hippocratic | 80 | 0.95 | hippocratic licen[cs]e | hippocratic
anti-996 | 80 | 0.95 | anti 996 licen[cs]e | 996 anti
cern-ohl | 80 | 0.95 | cern (?:ohl|open hardware licen[cs]e)(?: [psw])? | cern ohl/hardware
tapr-ohl | 80 | 0.95 | tapr open hardware licen[cs]e | tapr hardware
solderpad | 80 | 0.95 | solderpad hardware licen[cs]e | solderpad hardware
free-art | 80 | 0.95 | (?:free art licen[cs]e|licence art libre)(?: 1 [123])? | art free/libre
gnu-generic | 30 | 0.6 | gnu (?:lesser |affero |library )?general public licen[cs]e | gnu
cc-generic | 30 | 0.6 | (?:cc by(?: nc)?(?: sa| nd)?|creative commons (?:attribution|licen[cs]e)) | cc/creative
unknown-license | 10 | 0.4 | licen[cs]ed under | under licensed/licenced
unknown-license | 10 | 0.4 | see (?:the )?licen[cs]e (?:file|txt|md) | see file/txt/md
unknown-license | 10 | 0.4 | (?:released|distributed|available) under (?:the )?(?:terms of )?(?:the |an? )?(?:following )?(?:open source )?licen[cs]e | under released/distributed/available
unknown-license | 9 | 0.4 | licen[cs]e agreement | agreement
unknown-license | 9 | 0.4 | sous licence | sous licence
unknown-license | 9 | 0.4 | lizenziert unter | lizenziert unter
unknown-license | 9 | 0.4 | bajo (?:la )?licencia | bajo licencia
"""
