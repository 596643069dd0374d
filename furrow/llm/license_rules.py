"""Signature rules of the licence scan: label, priority, keywords, pattern.

A rule is tried on a document only if all of its keywords occur there as words.
Patterns run on the text with A-Z lower-cased; SEP stands between words of a name.
Higher priority wins where one detection lies inside another.
"""

SEP = r"[^0-9a-z\x80-\U0010ffff]+"
END = r"(?![0-9a-z\x80-\U0010ffff])"
BEG = r"(?<![0-9a-z\x80-\U0010ffff])"

#: Names as they are written out: label, words (~ is any separator; version suffixes are optional groups).
NAMES = [
    ("mit", "mit~license"), ("mit", "the~mit~license"), ("mit", "mit~licen[cs]ed"), ("mit", "mit~style~license"), ("mit", "expat~license"), ("mit", "released~under~the~mit~license"), ("mit", "x11~license"),
    ("mit", "permission~is~hereby~granted~free~of~charge~to~any~person~obtaining~a~copy"),
    ("mit-0", "mit~no~attribution"), ("mit-0", "mit~0~license"),
    ("apache", "apache~license"), ("apache", "apache~software~license"), ("apache-2.0", "apache~license~version~2(?:~0)?"), ("apache-2.0", "apache~2~0"), ("apache-2.0", "apache~2~license"), ("apache-2.0", "apache~license~2(?:~0)?"), ("apache-1.1", "apache~(?:software~)?license~version~1~1"), ("apache-1.0", "apache~(?:software~)?license~version~1~0"), ("apache-2.0", "licensed~under~the~apache~license~version~2~0"), ("apache-2.0", "apache~org~licenses~license~2~0"),
    ("gpl", "general~public~license"), ("gpl", "gnu~general~public~license"), ("gpl", "gnu~gpl"), ("gpl-1.0", "general~public~license~(?:version~|v)1"), ("gpl-2.0", "general~public~license~(?:version~|v)2"), ("gpl-3.0", "general~public~license~(?:version~|v)3"), ("gpl-2.0", "gplv2"), ("gpl-2.0", "gpl~v2"), ("gpl-3.0", "gplv3"), ("gpl-3.0", "gpl~v3"), ("gpl-2.0", "gpl~2~0"), ("gpl-3.0", "gpl~3~0"), ("gpl", "free~software~you~can~redistribute~it~and~or~modify~it~under~the~terms~of~the~gnu"), ("gpl-2.0", "version~2~of~the~gnu~general~public~license"), ("gpl-3.0", "version~3~of~the~gnu~general~public~license"), ("gpl-2.0", "gnu~org~licenses~gpl~2~0"), ("gpl-3.0", "gnu~org~licenses~gpl~3~0"), ("gpl", "gpl~or~later"), ("gpl-2.0", "gplv2~or~later"), ("gpl-3.0", "gplv3~or~later"),
    ("lgpl", "lesser~general~public~license"), ("lgpl", "library~general~public~license"), ("lgpl", "gnu~lgpl"), ("lgpl-2.1", "lesser~general~public~license~(?:version~|v)2~1"), ("lgpl-2.0", "library~general~public~license~(?:version~|v)2"), ("lgpl-3.0", "lesser~general~public~license~(?:version~|v)3"), ("lgpl-2.1", "lgpl~v?2~1"), ("lgpl-2.1", "lgplv2~1"), ("lgpl-3.0", "lgpl~v?3"), ("lgpl-3.0", "lgplv3"),
    ("agpl", "affero~general~public~license"), ("agpl-3.0", "affero~general~public~license~(?:version~|v)3"), ("agpl", "gnu~agpl"), ("agpl-3.0", "agpl~v?3"), ("agpl-3.0", "agplv3"), ("agpl-1.0", "affero~general~public~license~(?:version~|v)1"),
    ("gfdl", "free~documentation~license"), ("gfdl", "gnu~fdl"), ("gfdl-1.3", "free~documentation~license~version~1~3"), ("gfdl-1.2", "free~documentation~license~version~1~2"), ("gfdl-1.1", "free~documentation~license~version~1~1"),
    ("bsd", "bsd~license"), ("bsd", "bsd~style~license"), ("bsd", "berkeley~software~distribution~license"), ("bsd-2", "bsd~2~clause"), ("bsd-2", "2~clause~bsd"), ("bsd-2", "two~clause~bsd"), ("bsd-2", "simplified~bsd"), ("bsd-2", "freebsd~license"), ("bsd-3", "bsd~3~clause"), ("bsd-3", "3~clause~bsd"), ("bsd-3", "three~clause~bsd"), ("bsd-3", "new~bsd~license"), ("bsd-3", "modified~bsd~license"), ("bsd-3", "revised~bsd~license"), ("bsd-4", "bsd~4~clause"), ("bsd-4", "4~clause~bsd"), ("bsd-4", "original~bsd~license"), ("bsd-0", "zero~clause~bsd"), ("bsd-0", "bsd~zero~clause"), ("bsd-0", "0bsd"), ("bsd", "redistribution~and~use~in~source~and~binary~forms"), ("bsd-3", "neither~the~name~of~.{1,120}?~nor~the~names~of~(?:its|their)~contributors"), ("bsd-4", "all~advertising~materials~mentioning~features~or~use~of~this~software"),
    ("isc", "isc~license"), ("isc", "permission~to~use~copy~modify~and~or~distribute~this~software~for~any~purpose"),
    ("mpl", "mozilla~public~license"), ("mpl-1.0", "mozilla~public~license~(?:version~|v)1~0"), ("mpl-1.1", "mozilla~public~license~(?:version~|v)1~1"), ("mpl-2.0", "mozilla~public~license~(?:version~|v)2(?:~0)?"), ("mpl-2.0", "mozilla~org~mpl~2~0"), ("mpl-2.0", "mpl~2~0"), ("mpl-1.1", "mpl~1~1"),
    ("epl", "eclipse~public~license"), ("epl-1.0", "eclipse~public~license~(?:version~|v)1~0"), ("epl-2.0", "eclipse~public~license~(?:version~|v)2~0"), ("edl-1.0", "eclipse~distribution~license"),
    ("cddl", "common~development~and~distribution~license"), ("cddl-1.0", "cddl~1~0"), ("cddl-1.1", "cddl~1~1"), ("cpl-1.0", "common~public~license"), ("cpal-1.0", "common~public~attribution~license"),
    ("eupl", "european~union~public~licen[cs]e"), ("eupl-1.2", "european~union~public~licen[cs]e~(?:version~|v)1~2"), ("eupl-1.1", "european~union~public~licen[cs]e~(?:version~|v)1~1"), ("eupl-1.2", "eupl~1~2"),
    ("artistic", "artistic~license"), ("artistic-2.0", "artistic~license~(?:version~)?2~0"), ("artistic-1.0", "artistic~license~(?:version~)?1~0"), ("perl", "same~terms~as~perl~itself"),
    ("bsl-1.0", "boost~software~license"), ("busl-1.1", "business~source~license"), ("elastic-2.0", "elastic~license~(?:version~)?2~0"), ("elastic", "elastic~license"), ("sspl-1.0", "server~side~public~license"), ("commons-clause", "commons~clause~license~condition"), ("confluent", "confluent~community~license"),
    ("zlib", "zlib~license"), ("zlib", "zlib~libpng~license"), ("libpng", "libpng~license"), ("unlicense", "the~unlicense"), ("unlicense", "free~and~unencumbered~software~released~into~the~public~domain"), ("wtfpl", "do~what~the~fuck~you~want~to~public~license"), ("wtfpl", "wtfpl"), ("beerware", "beerware~license"), ("beerware", "beer~ware~license"),
    ("public-domain", "released~into~the~public~domain"), ("public-domain", "dedicated~to~the~public~domain"), ("public-domain", "in~the~public~domain"), ("cc0", "cc0~1~0"), ("cc0", "creative~commons~zero"), ("cc0", "creativecommons~org~publicdomain~zero"), ("pddl-1.0", "public~domain~dedication~and~license"),
    ("cc", "creative~commons"), ("cc", "creative~commons~license"), ("cc-by", "creative~commons~attribution"), ("cc-by", "cc~by"), ("cc-by-4.0", "cc~by~4~0"), ("cc-by-3.0", "cc~by~3~0"), ("cc-by-2.5", "cc~by~2~5"), ("cc-by-2.0", "cc~by~2~0"), ("cc-by-sa", "cc~by~sa"), ("cc-by-sa-4.0", "cc~by~sa~4~0"), ("cc-by-sa-3.0", "cc~by~sa~3~0"), ("cc-by-nc", "cc~by~nc"), ("cc-by-nc-4.0", "cc~by~nc~4~0"), ("cc-by-nc-3.0", "cc~by~nc~3~0"), ("cc-by-nd", "cc~by~nd"), ("cc-by-nd-4.0", "cc~by~nd~4~0"), ("cc-by-nc-sa", "cc~by~nc~sa"), ("cc-by-nc-sa-4.0", "cc~by~nc~sa~4~0"), ("cc-by-nc-sa-3.0", "cc~by~nc~sa~3~0"), ("cc-by-nc-nd", "cc~by~nc~nd"), ("cc-by-nc-nd-4.0", "cc~by~nc~nd~4~0"), ("cc-by-nc-nd-3.0", "cc~by~nc~nd~3~0"),
    ("cc-by-4.0", "creative~commons~attribution~4~0"), ("cc-by-4.0", "attribution~4~0~international"), ("cc-by-sa", "attribution~share~?alike"), ("cc-by-sa-4.0", "attribution~share~?alike~4~0"), ("cc-by-sa-3.0", "attribution~share~?alike~3~0"), ("cc-by-nc", "attribution~non~?commercial"), ("cc-by-nc-4.0", "attribution~non~?commercial~4~0"), ("cc-by-nd", "attribution~no~?deriv(?:ative)?s"), ("cc-by-nc-sa", "attribution~non~?commercial~share~?alike"), ("cc-by-nc-nd", "attribution~non~?commercial~no~?deriv(?:ative)?s"),
    ("cc-by", "creativecommons~org~licenses~by"), ("cc-by-sa", "creativecommons~org~licenses~by~sa"), ("cc-by-nc", "creativecommons~org~licenses~by~nc"), ("cc-by-nd", "creativecommons~org~licenses~by~nd"), ("cc-by-nc-sa", "creativecommons~org~licenses~by~nc~sa"), ("cc-by-nc-nd", "creativecommons~org~licenses~by~nc~nd"),
    ("odbl", "open~database~license"), ("odbl", "opendatacommons~org~licenses~odbl"), ("odc-by", "open~data~commons~attribution~license"), ("ogl", "open~government~licen[cs]e"), ("ogl-3.0", "open~government~licen[cs]e~v(?:ersion~)?3"), ("cdla-permissive", "community~data~license~agreement~permissive"), ("cdla-sharing", "community~data~license~agreement~sharing"),
    ("openrail", "openrail"), ("openrail-m", "openrail~m"), ("bigcode-openrail-m", "bigcode~openrail~m"), ("creativeml-openrail-m", "creativeml~open~?rail~m"), ("llama", "llama~(?:\\d~)*community~license"), ("gemma", "gemma~terms~of~use"),
    ("python", "python~software~foundation~license"), ("python", "psf~license"), ("php", "php~license"), ("ruby", "ruby~license"), ("openssl", "openssl~license"), ("tcl-tk", "tcl~tk~license"), ("vim", "vim~license"), ("postgresql", "postgresql~license"), ("curl", "curl~license"), ("ncsa", "university~of~illinois~ncsa~open~source~license"), ("afl-3.0", "academic~free~license"), ("osl-3.0", "open~software~license"), ("apsl-2.0", "apple~public~source~license"), ("ms-pl", "microsoft~public~license"), ("ms-rl", "microsoft~reciprocal~license"), ("ofl-1.1", "sil~open~font~license"), ("ofl-1.1", "open~font~license"), ("ipl-1.0", "ibm~public~license"), ("lppl", "latex~project~public~license"), ("mulan-2.0", "mulan~psl"), ("qpl-1.0", "q~public~license"), ("sleepycat", "sleepycat~license"), ("spl-1.0", "sun~public~license"), ("upl-1.0", "universal~permissive~license"), ("vsl-1.0", "vovida~software~license"), ("w3c", "w3c~software~notice~and~license"), ("zpl-2.1", "zope~public~license"), ("blueoak-1.0", "blue~oak~model~license"), ("cecill", "cecill"), ("json", "the~software~shall~be~used~for~good~not~evil"), ("hippocratic", "hippocratic~license"), ("parity", "parity~public~license"), ("polyform-nc", "polyform~noncommercial~license"), ("polyform-sb", "polyform~small~business~license"),
    ("proprietary", "all~rights~reserved"), ("proprietary", "proprietary~and~confidential"), ("proprietary", "unauthorized~(?:copying|reproduction)~of~this~file"), ("copyright-notice", "copyright~c?~?(?:19|20)\\d\\d"), ("non-commercial", "for~noncommercial~(?:use|purposes)~only"), ("non-commercial", "for~non~commercial~(?:use|purposes)~only"),
]

#: SPDX identifiers; each makes a rule for its tag and one for its licence page.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 "
    "CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CC-BY-ND-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 "
    "ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later HPND ISC "
    "LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 "
    "NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 QPL-1.0 SSPL-1.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()


def rules() -> list[tuple[str, int, tuple[str, ...], str]]:
    """(label, priority, keywords, pattern): longer names outrank shorter ones, SPDX tags all names."""
    import re

    out = []
    for label, name in NAMES:
        parts = [x for x in name.split("~") if x]
        fixed = tuple(dict.fromkeys(x for x in parts if re.fullmatch("[0-9a-z]+", x) and f"{x}~?" not in name))
        body = name.replace("~?", f"(?:{SEP})?").replace("~", SEP)
        out.append((label, 10 * len(parts), fixed, BEG + body + END))
    for i in SPDX:
        label, dashed = i.lower(), re.escape(i.lower())
        out.append((label, 1000, ("spdx",), BEG + rf"spdx{SEP}license{SEP}identifier:?\s*\(?{dashed}" + END))
        for word in ("license", "licenses"):
            out.append((label, 900, (word, "opensource"), BEG + rf"opensource\.org/{word}/{dashed}" + END))
        out.append((label, 900, ("licenses", "spdx"), BEG + rf"spdx\.org/licenses/{dashed}" + END))
    return out
