"""A small tree of hand-made notes, one for each quirk."""

NOTES = {
    "Land/Companies/Acme Mine.md": "---\nentity: Acme\nname: Acme Mining\nsector: Mining\ncountry: [[Land]]\naliases:\n  - ACME\n  - 7\n  - Acme Co\n---\n# Summary\nDigs lithium.\n\n## Links\n[[Ministry of Mines|the ministry]] [[x/y/Lithium]] [[lithium]] [[Ghost Town]] [[ghost town]] [[Acme Mine]]\n",
    "Land/Government/Ministry of Mines.md": "---\nnode_type: government_ministry\nlast_updated: 2026-01-02\ndescription:\n  - Licenses mines.\n  - More.\n---\nRegulates [[acme-mine]].\n\n## Key Contacts\nJane\n\n## Licenses\n",
    "Land/Commodities/Lithium.md": "---\r\nnote: A metal.\r\nCountry: Land\r\ntype: commodity\r\n---\r\nUsed by [[ACME]].\r\n",
    "Land/Broken.md": "---\nkey: [unclosed\n---\n  Body of the broken one about a railway.  \n",
    "Land/Plain.md": "No header. A university here. [[Lithium]]",
    "Land/Empty Summary.md": "---\ntitle: Empty\n---\n# Summary\n\n## Core Information\nfacts\n",
    "Land/A/Twin.md": "---\nsummary: first\n---\nfirst twin",
    "Land/B/Twin.md": "---\nsummary: second\n---\nsecond twin",
    "Land/.hidden/Secret.md": "---\nsummary: hidden\n---\nx",
    "Land/Listy.md": "---\nsummary:\n  - [[Nested]]\n  - text\nAbstract: late\n---\nbody",
    "Land/Ünïcode Näme.md": "---\nsummary: \"  \"\n---\n" + "ä" * 500,
}

VISIBLE = len(NOTES) - 1  #: hidden folders are not read


def write(root):
    for path, text in NOTES.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text.encode())
    (root / "Land" / "bad.md").write_bytes(b"\xff\xfe not utf-8")
    (root / "Land" / "readme.txt").write_text("no note")
    return str(root)
