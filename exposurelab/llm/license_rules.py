"""Signatures of licenses: one regex per line, in the order in which they are tried.

``label | priority | keywords | regex``.  Regexes match whole words of a text in lower
case whose punctuation is gone; one blank stands between two words.  Every match holds
all of its rule's keywords.  Priorities: 4 identifiers and addresses, 3 notices and
sentences of a license, 2 names with a version, 1 names alone.
"""

RULES = r"""
# Apache
apache-2.0 | 4 | spdx apache | spdx license identifier apache 2 0
apache-2.0 | 4 | apache licenses | (?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2.0 | 4 | opensource apache | opensource org licen[sc]es? apache 2 0
apache-2.0 | 3 | licensed apache | licensed under (?:the )?apache licen[sc]e(?: version)? 2(?: 0)?
apache-2.0 | 3 | licensed apache | licensed under (?:the )?terms of (?:the )?apache licen[sc]e(?: version)? 2(?: 0)?
apache-2.0 | 3 | compliance license | you may not use this file except in compliance with the license
apache-2.0 | 3 | grants contributor | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) license
apache-2.0 | 2 | apache | apache (?:software )?licen[sc]e(?: version| v)? v?2(?: 0)?
apache-2.0 | 2 | apache | apache(?: version| v)? v?2 0 licen[sc]e
apache-2.0 | 2 | apache v2 | apache v2(?: 0)?(?: licen[sc]e)?
apache-2.0 | 2 | apache2 | apache2(?: 0)? licen[sc]ed?
apache-1.1 | 4 | spdx apache | spdx license identifier apache 1 1
apache-1.1 | 2 | apache | apache (?:software )?licen[sc]e(?: version| v)? v?1 1
apache-1.0 | 2 | apache | apache (?:software )?licen[sc]e(?: version| v)? v?1 0
apache | 1 | apache | apache (?:software )?licen[sc]e
apache | 1 | apache | apache licensed
# MIT and close relatives
mit | 4 | spdx mit | spdx license identifier mit
mit | 4 | opensource mit | opensource org licen[sc]es? mit(?: license)?(?: php| html)?
mit | 4 | mit | mit license org
mit | 3 | mit | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?mit licen[sc]e
mit | 3 | distributed mit | distributed under (?:the )?(?:terms of (?:the )?)?mit licen[sc]e
mit | 3 | available mit | available under (?:the )?(?:terms of (?:the )?)?mit licen[sc]e
mit | 3 | hereby granted charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 3 | sublicense copies | to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | 2 | mit | (?:the )?mit x11 licen[sc]e
mit | 2 | expat | (?:the )?expat licen[sc]e
mit | 2 | mit | mit style licen[sc]e
mit-0 | 4 | spdx mit | spdx license identifier mit 0
mit-0 | 2 | mit | mit no attribution(?: licen[sc]e)?
mit | 1 | mit | (?:the )?mit licen[sc]e
mit | 1 | mit | mit licensed
x11 | 2 | x11 | x11 licen[sc]e
isc | 4 | spdx isc | spdx license identifier isc
isc | 4 | opensource isc | opensource org licen[sc]es? isc(?: license)?
isc | 3 | isc | (?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?isc licen[sc]e
isc | 3 | distribute purpose fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 1 | isc | isc licen[sc]e
0bsd | 4 | spdx 0bsd | spdx license identifier 0bsd
0bsd | 2 | bsd | zero clause bsd(?: licen[sc]e)?
0bsd | 2 | 0bsd | 0bsd(?: licen[sc]e)
# BSD
bsd-2-clause | 4 | spdx bsd | spdx license identifier bsd 2 clause
bsd-3-clause | 4 | spdx bsd | spdx license identifier bsd 3 clause
bsd-4-clause | 4 | spdx bsd | spdx license identifier bsd 4 clause
bsd-2-clause | 4 | opensource bsd | opensource org licen[sc]es? bsd 2 clause
bsd-3-clause | 4 | opensource bsd | opensource org licen[sc]es? bsd 3 clause
bsd-3-clause | 3 | endorse promote | neither the names? of (?:[^ ]+ ){1,15}may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | 3 | licensed bsd | licensed under (?:the )?(?:terms of (?:the )?)?(?:3|three) clause bsd(?: licen[sc]e)?
bsd-2-clause | 3 | licensed bsd | licensed under (?:the )?(?:terms of (?:the )?)?(?:2|two) clause bsd(?: licen[sc]e)?
bsd-4-clause | 3 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | 3 | redistribution binary | redistribution and use in source and binary forms with or without modification are permitted
bsd | 3 | redistributions retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause | 2 | bsd | (?:2|two) clause bsd(?: licen[sc]e)?
bsd-2-clause | 2 | simplified bsd | simplified bsd licen[sc]e
bsd-2-clause | 2 | freebsd | freebsd licen[sc]e
bsd-2-clause | 2 | bsd clause | bsd (?:2|two) clause(?: licen[sc]e)?
bsd-3-clause | 2 | bsd | (?:3|three) clause bsd(?: licen[sc]e)?
bsd-3-clause | 2 | bsd clause | bsd (?:3|three) clause(?: licen[sc]e)?
bsd-3-clause | 2 | bsd | (?:new|modified|revised) bsd licen[sc]e
bsd-4-clause | 2 | bsd | (?:4|four) clause bsd(?: licen[sc]e)?
bsd-4-clause | 2 | original bsd | original bsd licen[sc]e
bsd | 1 | bsd | bsd (?:style )?licen[sc]e
bsd | 1 | bsd | bsd licensed
# GNU General Public License
gpl-1.0 | 4 | spdx gpl | spdx license identifier gpl 1 0(?: only| or later)?
gpl-2.0 | 4 | spdx gpl | spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later | 4 | spdx gpl later | spdx license identifier gpl 2 0 or later
gpl-3.0 | 4 | spdx gpl | spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later | 4 | spdx gpl later | spdx license identifier gpl 3 0 or later
gpl-2.0 | 4 | gnu | gnu org (?:old )?licen[sc]es (?:old licen[sc]es )?gpl 2 0(?: html| txt| en html)?
gpl-3.0 | 4 | gnu | gnu org licen[sc]es gpl 3 0(?: html| txt| en html)?
gpl | 4 | gnu | gnu org (?:licen[sc]es|copyleft) gpl(?: html| txt| en html)?
gpl-2.0 | 4 | opensource gpl | opensource org licen[sc]es? gpl 2 0
gpl-3.0 | 4 | opensource gpl | opensource org licen[sc]es? gpl 3 0
gpl-2.0-or-later | 3 | general public later | gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version
gpl-3.0-or-later | 3 | general public later | gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
gpl-2.0 | 3 | general public foundation | gnu general public licen[sc]e version 2 as published by the free software foundation
gpl-3.0 | 3 | general public foundation | gnu general public licen[sc]e version 3 as published by the free software foundation
gpl-3.0 | 3 | licensed general public | licensed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public licen[sc]e(?: version| v)? v?3(?: 0)?
gpl-2.0 | 3 | licensed general public | licensed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public licen[sc]e(?: version| v)? v?2(?: 0)?
gpl | 3 | redistribute general public | you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
gpl | 3 | received general public | you should have received a copy of the gnu general public licen[sc]e
gpl-3.0 | 2 | general public | (?:gnu )?general public licen[sc]e(?: version| v)? v?3(?: 0)?
gpl-2.0 | 2 | general public | (?:gnu )?general public licen[sc]e(?: version| v)? v?2(?: 0)?
gpl-1.0 | 2 | general public | (?:gnu )?general public licen[sc]e(?: version| v)? v?1(?: 0)?
gpl-3.0 | 2 | gplv3 | (?:gnu )?gplv3(?: 0)?(?: only)?
gpl-3.0-or-later | 2 | gplv3 later | (?:gnu )?gplv3(?: 0)? or (?:any )?later
gpl-2.0 | 2 | gplv2 | (?:gnu )?gplv2(?: 0)?(?: only)?
gpl-2.0-or-later | 2 | gplv2 later | (?:gnu )?gplv2(?: 0)? or (?:any )?later
gpl-3.0 | 2 | gpl | (?:gnu )?gpl(?: version| v)? v?3(?: 0)?
gpl-2.0 | 2 | gpl | (?:gnu )?gpl(?: version| v)? v?2(?: 0)?
gpl-3.0 | 2 | gpl v3 | (?:gnu )?gpl v3(?: 0)?
gpl-2.0 | 2 | gpl v2 | (?:gnu )?gpl v2(?: 0)?
gpl-3.0 | 2 | gpl3 | gpl3
gpl-2.0 | 2 | gpl2 | gpl2
gpl | 1 | gnu general public | gnu general public licen[sc]e
gpl | 1 | gnu gpl | gnu gpl
gpl | 1 | gpl | gpl licen[sc]ed?
# Lesser and Affero
lgpl-2.0 | 4 | spdx lgpl | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 | 4 | spdx lgpl | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 | 4 | spdx lgpl | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2.1 | 4 | gnu lgpl | gnu org licen[sc]es (?:old licen[sc]es )?lgpl 2 1(?: html| txt)?
lgpl-3.0 | 4 | gnu lgpl | gnu org licen[sc]es lgpl 3 0(?: html| txt)?
lgpl | 4 | gnu lgpl | gnu org (?:licen[sc]es|copyleft) lgpl(?: html| txt)?
lgpl-2.1 | 3 | lesser public later | gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1 of the licen[sc]e or at your option any later version
lgpl-3.0 | 3 | lesser public later | gnu lesser general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
lgpl | 3 | lesser received | you should have received a copy of the gnu lesser general public licen[sc]e
lgpl-2.1 | 2 | lesser public | (?:gnu )?lesser general public licen[sc]e(?: version| v)? v?2 1
lgpl-3.0 | 2 | lesser public | (?:gnu )?lesser general public licen[sc]e(?: version| v)? v?3(?: 0)?
lgpl-2.0 | 2 | library public | (?:gnu )?library general public licen[sc]e(?: version| v)? v?2(?: 0)?
lgpl-2.1 | 2 | lgpl | (?:gnu )?lgpl(?: version| v)? v?2 1
lgpl-3.0 | 2 | lgpl | (?:gnu )?lgpl(?: version| v)? v?3(?: 0)?
lgpl-2.1 | 2 | lgplv2 | (?:gnu )?lgplv2(?: 1)?
lgpl-3.0 | 2 | lgplv3 | (?:gnu )?lgplv3
lgpl | 2 | lesser public | (?:gnu )?lesser general public licen[sc]e
lgpl | 2 | library public | (?:gnu )?library general public licen[sc]e
lgpl | 1 | lgpl | (?:gnu )?lgpl(?: licen[sc]ed?)?
agpl-3.0 | 4 | spdx agpl | spdx license identifier agpl 3 0(?: only| or later)?
agpl-1.0 | 4 | spdx agpl | spdx license identifier agpl 1 0(?: only| or later)?
agpl-3.0 | 4 | gnu agpl | gnu org licen[sc]es agpl 3 0(?: html| txt)?
agpl-3.0 | 3 | affero public later | gnu affero general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
agpl-3.0 | 2 | affero public | (?:gnu )?affero general public licen[sc]e(?: version| v)? v?3(?: 0)?
agpl-3.0 | 2 | agplv3 | (?:gnu )?agplv3
agpl-3.0 | 2 | agpl | (?:gnu )?agpl(?: version| v)? v?3(?: 0)?
agpl | 2 | affero public | (?:gnu )?affero general public licen[sc]e
agpl | 1 | agpl | (?:gnu )?agpl(?: licen[sc]ed?)?
gfdl-1.3 | 4 | spdx gfdl | spdx license identifier gfdl 1 3(?: only| or later)?
gfdl-1.2 | 4 | spdx gfdl | spdx license identifier gfdl 1 2(?: only| or later)?
gfdl | 4 | gnu fdl | gnu org (?:licen[sc]es|copyleft) fdl(?: html| txt)?
gfdl-1.3 | 2 | free documentation | (?:gnu )?free documentation licen[sc]e(?: version| v)? v?1 3
gfdl-1.2 | 2 | free documentation | (?:gnu )?free documentation licen[sc]e(?: version| v)? v?1 2
gfdl | 1 | free documentation | (?:gnu )?free documentation licen[sc]e
gfdl | 1 | gfdl | (?:gnu )?gfdl
# Mozilla, Eclipse and other weak copyleft
mpl-2.0 | 4 | spdx mpl | spdx license identifier mpl 2 0
mpl-1.1 | 4 | spdx mpl | spdx license identifier mpl 1 1
mpl-2.0 | 4 | mozilla mpl | (?:www )?mozilla org (?:en us )?mpl 2 0
mpl-1.1 | 4 | mozilla mpl | (?:www )?mozilla org mpl (?:mpl )?1 1(?: html)?
mpl-2.0 | 3 | subject mozilla | this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
mpl-1.1 | 3 | contents mozilla | the contents of this file are subject to the mozilla public licen[sc]e version 1 1
mpl-2.0 | 2 | mozilla public | mozilla public licen[sc]e(?: version| v)? v?2(?: 0)?
mpl-1.1 | 2 | mozilla public | mozilla public licen[sc]e(?: version| v)? v?1 1
mpl-1.0 | 2 | mozilla public | mozilla public licen[sc]e(?: version| v)? v?1 0
mpl-2.0 | 2 | mpl | mpl(?: version| v)? v?2 0
mpl | 1 | mozilla public | mozilla public licen[sc]e
epl-2.0 | 4 | spdx epl | spdx license identifier epl 2 0
epl-1.0 | 4 | spdx epl | spdx license identifier epl 1 0
epl-2.0 | 4 | eclipse epl | (?:www )?eclipse org (?:legal )?epl (?:v )?2 0(?: html)?
epl-2.0 | 4 | eclipse v20 | (?:www )?eclipse org (?:legal )?epl v20(?: html)?
epl-1.0 | 4 | eclipse v10 | (?:www )?eclipse org (?:legal )?epl v10(?: html)?
epl-2.0 | 2 | eclipse public | eclipse public licen[sc]e(?: version| v)? v?2(?: 0)?
epl-1.0 | 2 | eclipse public | eclipse public licen[sc]e(?: version| v)? v?1(?: 0)?
epl | 1 | eclipse public | eclipse public licen[sc]e
edl-1.0 | 2 | eclipse distribution | eclipse distribution licen[sc]e(?: version| v)?(?: v?1 0)?
cddl-1.0 | 4 | spdx cddl | spdx license identifier cddl 1 0
cddl-1.1 | 4 | spdx cddl | spdx license identifier cddl 1 1
cddl-1.1 | 2 | development distribution | common development and distribution licen[sc]e(?: version| v)? v?1 1
cddl-1.0 | 2 | development distribution | common development and distribution licen[sc]e(?: version| v)? v?1 0
cddl | 1 | development distribution | common development and distribution licen[sc]e
cpl-1.0 | 4 | spdx cpl | spdx license identifier cpl 1 0
cpl-1.0 | 2 | common public | common public licen[sc]e(?: version| v)?(?: v?1 0)?
eupl-1.2 | 4 | spdx eupl | spdx license identifier eupl 1 2
eupl-1.1 | 4 | spdx eupl | spdx license identifier eupl 1 1
eupl-1.2 | 2 | european union public | european union public licen[sc]e(?: version| v)? v?1 2
eupl | 1 | european union public | european union public licen[sc]e
eupl | 1 | eupl | eupl(?: v)?(?: 1 [12])?
ms-pl | 4 | spdx ms pl | spdx license identifier ms pl
ms-pl | 2 | microsoft public | microsoft public licen[sc]e
ms-rl | 4 | spdx ms rl | spdx license identifier ms rl
ms-rl | 2 | microsoft reciprocal | microsoft reciprocal licen[sc]e
osl-3.0 | 4 | spdx osl | spdx license identifier osl 3 0
osl-3.0 | 2 | open software | open software licen[sc]e(?: version| v)? v?3 0
afl-3.0 | 4 | spdx afl | spdx license identifier afl 3 0
afl | 2 | academic free | academic free licen[sc]e(?: version| v)?(?: [123] [01])?
artistic-2.0 | 4 | spdx artistic | spdx license identifier artistic 2 0
artistic-1.0 | 4 | spdx artistic | spdx license identifier artistic 1 0(?: perl| cl8)?
artistic-2.0 | 2 | artistic | artistic licen[sc]e(?: version| v)? v?2(?: 0)?
artistic-1.0 | 2 | artistic | artistic licen[sc]e(?: version| v)? v?1(?: 0)?
artistic | 1 | artistic | (?:perl )?artistic licen[sc]e
perl | 3 | same perl | under the same terms as perl itself
qpl-1.0 | 2 | q public | q public licen[sc]e(?: version| v)?(?: v?1 0)?
ecl-2.0 | 2 | educational community | educational community licen[sc]e(?: version| v)?(?: 2 0)?
cecill | 2 | cecill | cecill(?: b| c)?(?: licen[sc]e)?(?: version| v)?(?: [12] [01])?
# Permissive others
bsl-1.0 | 4 | spdx bsl | spdx license identifier bsl 1 0
bsl-1.0 | 4 | boost license | (?:www )?boost org license 1 0(?: txt)?
bsl-1.0 | 3 | distributed boost | distributed under the boost software licen[sc]e version 1 0
bsl-1.0 | 2 | boost software | boost software licen[sc]e(?: version| v)?(?: v?1 0)?
zlib | 4 | spdx zlib | spdx license identifier zlib
zlib | 3 | misrepresented origin | the origin of this software must not be misrepresented
zlib | 2 | zlib | zlib (?:libpng )?licen[sc]e
libpng | 2 | libpng | libpng licen[sc]e
unlicense | 4 | spdx unlicense | spdx license identifier unlicense
unlicense | 4 | unlicense | (?:www )?unlicense org
unlicense | 3 | unencumbered public | this is free and unencumbered software released into the public domain
unlicense | 1 | unlicense | (?:the )?unlicense
wtfpl | 4 | spdx wtfpl | spdx license identifier wtfpl
wtfpl | 1 | wtfpl | wtfpl(?: licen[sc]e)?
postgresql | 4 | spdx postgresql | spdx license identifier postgresql
postgresql | 2 | postgresql | postgresql licen[sc]e
ncsa | 4 | spdx ncsa | spdx license identifier ncsa
ncsa | 2 | illinois ncsa | university of illinois ncsa open source licen[sc]e
psf-2.0 | 4 | spdx psf | spdx license identifier psf 2 0
psf-2.0 | 2 | python foundation | python software foundation licen[sc]e(?: version| v)?(?: 2)?
python | 1 | python | python licen[sc]e
ruby | 2 | ruby | ruby licen[sc]e
ruby | 3 | same ruby | under the same terms as ruby(?: itself)?
php-3.01 | 4 | spdx php | spdx license identifier php 3 01
php-3.01 | 2 | php | php licen[sc]e(?: version| v)? v?3 01
php | 1 | php | php licen[sc]e
openssl | 2 | openssl | openssl licen[sc]e
curl | 4 | spdx curl | spdx license identifier curl
ofl-1.1 | 4 | spdx ofl | spdx license identifier ofl 1 1
ofl-1.1 | 4 | scripts ofl | scripts sil org ofl
ofl-1.1 | 2 | sil font | sil open font licen[sc]e(?: version| v)?(?: 1 1)?
ofl | 1 | open font | open font licen[sc]e
w3c | 4 | spdx w3c | spdx license identifier w3c
w3c | 2 | w3c software | w3c software (?:notice and )?licen[sc]e
unicode | 2 | unicode | unicode (?:data files and software )?licen[sc]e(?: agreement)?
vim | 2 | vim | vim licen[sc]e
blueoak-1.0.0 | 2 | blue oak | blue oak model licen[sc]e(?: 1 0 0)?
upl-1.0 | 2 | universal permissive | universal permissive licen[sc]e(?: version| v)?(?: v?1 0)?
beerware | 2 | beerware | beerware(?: licen[sc]e)?
json | 3 | good evil software | the software shall be used for good not evil
# Creative Commons
cc0-1.0 | 4 | spdx cc0 | spdx license identifier cc0 1 0
cc0-1.0 | 4 | creativecommons publicdomain zero | creativecommons org publicdomain zero 1 0
cc0-1.0 | 2 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 2 | commons zero | creative commons zero(?: v)?(?: 1 0)?
cc-pdm-1.0 | 4 | creativecommons publicdomain mark | creativecommons org publicdomain mark 1 0
cc-by-4.0 | 4 | spdx cc by | spdx license identifier cc by 4 0
cc-by-sa-4.0 | 4 | spdx cc sa | spdx license identifier cc by sa 4 0
cc-by-nc-4.0 | 4 | spdx cc nc | spdx license identifier cc by nc 4 0
cc-by-4.0 | 4 | creativecommons | creativecommons org licen[sc]es by 4 0
cc-by-3.0 | 4 | creativecommons | creativecommons org licen[sc]es by 3 0
cc-by-2.0 | 4 | creativecommons | creativecommons org licen[sc]es by 2 0
cc-by-sa-4.0 | 4 | creativecommons sa | creativecommons org licen[sc]es by sa 4 0
cc-by-sa-3.0 | 4 | creativecommons sa | creativecommons org licen[sc]es by sa 3 0
cc-by-nc-4.0 | 4 | creativecommons nc | creativecommons org licen[sc]es by nc 4 0
cc-by-nc-3.0 | 4 | creativecommons nc | creativecommons org licen[sc]es by nc 3 0
cc-by-nd-4.0 | 4 | creativecommons nd | creativecommons org licen[sc]es by nd 4 0
cc-by-nc-sa-4.0 | 4 | creativecommons nc sa | creativecommons org licen[sc]es by nc sa 4 0
cc-by-nc-nd-4.0 | 4 | creativecommons nc nd | creativecommons org licen[sc]es by nc nd 4 0
cc-by-nc-sa-4.0 | 3 | cc nc sa | cc by nc sa 4 0
cc-by-nc-sa-3.0 | 3 | cc nc sa | cc by nc sa 3 0
cc-by-nc-nd-4.0 | 3 | cc nc nd | cc by nc nd 4 0
cc-by-nc-nd-3.0 | 3 | cc nc nd | cc by nc nd 3 0
cc-by-nc-4.0 | 3 | cc nc | cc by nc 4 0
cc-by-nc-3.0 | 3 | cc nc | cc by nc 3 0
cc-by-nd-4.0 | 3 | cc nd | cc by nd 4 0
cc-by-nd-3.0 | 3 | cc nd | cc by nd 3 0
cc-by-sa-4.0 | 3 | cc sa | cc by sa 4 0
cc-by-sa-3.0 | 3 | cc sa | cc by sa 3 0
cc-by-sa-2.0 | 3 | cc sa | cc by sa 2 0
cc-by-4.0 | 3 | cc by | cc by 4 0
cc-by-3.0 | 3 | cc by | cc by 3 0
cc-by-2.5 | 3 | cc by | cc by 2 5
cc-by-2.0 | 3 | cc by | cc by 2 0
cc-by-nc-sa | 2 | cc nc sa | cc by nc sa
cc-by-nc-nd | 2 | cc nc nd | cc by nc nd
cc-by-nc | 2 | cc nc | cc by nc
cc-by-nd | 2 | cc nd | cc by nd
cc-by-sa | 2 | cc sa | cc by sa
cc-by-nc-sa-4.0 | 3 | commons attribution | creative commons attribution (?:noncommercial|non commercial) (?:sharealike|share alike) 4 0(?: international)?
cc-by-nc-nd-4.0 | 3 | commons attribution | creative commons attribution (?:noncommercial|non commercial) (?:noderivatives|no derivatives) 4 0(?: international)?
cc-by-nc-4.0 | 3 | commons attribution noncommercial | creative commons attribution noncommercial 4 0(?: international)?
cc-by-sa-4.0 | 3 | commons attribution sharealike | creative commons attribution sharealike 4 0(?: international)?
cc-by-4.0 | 3 | commons attribution | creative commons attribution 4 0(?: international)?
cc-by-sa-3.0 | 3 | commons attribution sharealike | creative commons attribution sharealike 3 0(?: unported)?
cc-by-3.0 | 3 | commons attribution | creative commons attribution 3 0(?: unported)?
cc-by-nc-sa | 2 | commons attribution | creative commons attribution (?:noncommercial|non commercial) (?:sharealike|share alike)
cc-by-sa | 2 | commons attribution | creative commons attribution (?:sharealike|share alike)
cc-by-nc | 2 | commons attribution | creative commons attribution (?:noncommercial|non commercial)
cc-by | 1 | commons attribution | creative commons attribution(?: licen[sc]e)?
creative-commons | 1 | creative commons | creative commons(?: licen[sc]e)?
# Data and models
odbl-1.0 | 4 | opendatacommons odbl | opendatacommons org licen[sc]es odbl(?: 1 0)?
odbl-1.0 | 2 | open database | open (?:data commons open )?database licen[sc]e(?: version| v)?(?: v?1 0)?
odc-by-1.0 | 4 | opendatacommons by | opendatacommons org licen[sc]es by(?: 1 0)?
odc-by-1.0 | 2 | odc by | odc by(?: 1 0)?
pddl-1.0 | 4 | opendatacommons pddl | opendatacommons org licen[sc]es pddl(?: 1 0)?
pddl-1.0 | 2 | domain dedication | public domain dedication and licen[sc]e
cdla-permissive-2.0 | 4 | spdx cdla | spdx license identifier cdla permissive 2 0
cdla | 2 | data agreement | community data licen[sc]e agreement(?: permissive| sharing)?
ogl-3.0 | 2 | open government | open government licen[sc]e(?: version| v)?(?: 3(?: 0)?)?
openrail | 2 | openrail | (?:creativeml )?(?:bigscience )?openrail(?: m)?(?: licen[sc]e)?
llama | 2 | llama community | llama (?:[234] )?community licen[sc]e(?: agreement)?
# Source available and closed
busl-1.1 | 4 | spdx busl | spdx license identifier busl 1 1
busl-1.1 | 2 | business source | business source licen[sc]e(?: version| v)?(?: 1 1)?
sspl-1.0 | 4 | spdx sspl | spdx license identifier sspl 1 0
sspl-1.0 | 2 | server side public | server side public licen[sc]e(?: version| v)?(?: 1)?
elastic-2.0 | 2 | elastic | elastic licen[sc]e(?: version| v)?(?: 2 0)?
commons-clause | 2 | commons clause | commons clause(?: licen[sc]e)?(?: condition)?
polyform | 2 | polyform | polyform (?:noncommercial|small business|shield|strict|free trial|internal use|perimeter)(?: licen[sc]e)?
proprietary | 3 | confidential proprietary | (?:confidential and proprietary|proprietary and confidential)
proprietary | 3 | unauthorized copying | unauthorized copying of this (?:file|software|document) via any medium is strictly prohibited
proprietary | 2 | proprietary | proprietary licen[sc]e
shareware | 2 | shareware | shareware(?: licen[sc]e)?
freeware | 2 | freeware | freeware(?: licen[sc]e)?
eula | 2 | end user | end user licen[sc]e agreement
public-domain | 3 | public domain | (?:placed|released|dedicated|is) (?:in|into|to) the public domain
public-domain | 1 | public domain | public domain
copyright | 3 | copyright reserved | copyright (?:c )?(?:[0-9]{4} ){0,2}(?:[^ ]+ ){0,8}?all rights reserved
copyright | 2 | copyright | copyright c [0-9]{4}(?: [0-9]{4})?
copyright | 2 | copyright | copyright [0-9]{4}(?: [0-9]{4})?
"""
