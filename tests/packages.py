"""Small fixture packages; every test of the scan reads them all at once."""

from __future__ import annotations

from pathlib import Path

HEAD = '<?xml version="1.0" encoding="utf-8"?>\n'


def defs(body: str) -> str:
    return f"{HEAD}<Defs>{body}</Defs>"


def language(body: str) -> str:
    return f"{HEAD}<LanguageData>{body}</LanguageData>"


def patch(body: str) -> str:
    return f"{HEAD}<Patch>{body}</Patch>"


def thing(name: str, fields: str, tag: str = "ThingDef", attrs: str = "") -> str:
    return f"<{tag} {attrs}><defName>{name}</defName>{fields}</{tag}>"


def operation(kind: str, address: str, value: str, tag: str = "Operation") -> str:
    return (
        f'<{tag} Class="PatchOperation{kind}"><xpath>{address}</xpath>'
        f"<value>{value}</value></{tag}>"
    )


EN = "Languages/English"

PACKAGES: dict[str, dict[str, str | bytes]] = {
    "defs_only": {
        "Defs/Things.xml": defs(
            thing("Lamp", "<label>oil lamp</label><description>It gives light.</description>")
        ),
        "About/About.xml": HEAD + "<ModMetaData><name>Salt &amp; Pepper</name><packageId>salt.pepper</packageId>"
        "<supportedVersions><li>1.5</li><li>1.6</li></supportedVersions></ModMetaData>",
    },
    "keyed_plus_defs": {
        f"{EN}/Keyed/Keys.xml": language("<!-- menu --><Greeting>Hello there</Greeting>"),
        "Defs/Things.xml": defs(thing("Lamp", "<label>oil lamp</label><description>It glows.</description>")),
    },
    "partial_cover": {
        f"{EN}/DefInjected/ThingDef/Things.xml": language("<Lamp.label>oil lamp</Lamp.label>"),
        "Defs/Things.xml": defs(
            thing("Lamp", "<label>oil lamp</label>") + thing("Cut", "<label>cut wood</label>", "JobKind")
        ),
    },
    "empty_cover": {
        f"{EN}/DefInjected/ThingDef/readme.txt": "nothing here",
        "Defs/Things.xml": defs(thing("Lamp", "<label>oil lamp</label>")),
    },
    "dotted_type": {
        "Defs/Foo.xml": defs(thing("One", "<label>first one</label>", "My.Ns.FooDef")),
        "Patches/P.xml": patch(operation("Replace", 'Defs/FooDef[defName="One"]/label', "<label>patched one</label>")),
    },
    "stale": {
        f"{EN}/DefInjected/ThingDef/Things.xml": language("<Lamp.label>kitchen corner</Lamp.label>"),
        "Defs/Things.xml": defs(thing("Lamp", "<label>Kitchen</label>")),
    },
    "nested_version": {
        "1.6/Defs/Things.xml": defs(thing("Lamp", "<label>oil lamp</label>")),
    },
    "numeric_version": {
        "1.10/Defs/Things.xml": defs(thing("Lamp", "<label>newest lamp</label>")),
        "1.6/Defs/Things.xml": defs(thing("Lamp", "<label>older lamp</label>")),
    },
    "manifest": {
        "LoadFolders.xml": HEAD + "<loadFolders><v1.0><li>1.0</li></v1.0><v1.6><li>/</li><li>1.6</li><li>1.6/</li></v1.6></loadFolders>",
        "1.0/Defs/Things.xml": defs(thing("Old", "<label>old lamp</label>")),
        "1.6/Defs/Things.xml": defs(thing("New", "<label>new lamp</label>")),
    },
    "manifest_void": {
        "loadfolders.xml": HEAD + "<loadFolders><v1.6><li>Missing</li></v1.6></loadFolders>",
        "1.5/Defs/Things.xml": defs(thing("New", "<label>new lamp</label>")),
    },
    "conditional": {
        "LoadFolders.xml": HEAD + '<loadFolders><v1.6><li>/</li><li IfModActive="x.y">Mods/X</li></v1.6></loadFolders>',
        "Defs/Things.xml": defs(thing("Base", "<label>base lamp</label>")),
        "Mods/X/Defs/Things.xml": defs(thing("Extra", "<label>extra lamp</label>")),
    },
    "old_language": {
        f"1.4/{EN}/Keyed/K.xml": language("<K>old text</K>"),
        f"1.6/{EN}/Keyed/K.xml": language("<K>new text</K>"),
    },
    "root_language": {
        f"{EN}/Keyed/K.xml": language("<K>root text</K>"),
        f"1.6/{EN}/Keyed/K.xml": language("<K>deep text</K>"),
    },
    "inherit_files": {
        "Defs/A_child.xml": defs(thing("Leaf", "<label>leaf lamp</label>", attrs='ParentName="Base"')),
        "Defs/B_parent.xml": defs(
            '<ThingDef Name="Base" Abstract="True"><label>base</label>'
            "<description>From the base.</description></ThingDef>"
        ),
    },
    "inherit_chain": {
        "Defs/All.xml": defs(
            '<ThingDef Name="Grand" Abstract="True"><description>From grand.</description></ThingDef>'
            '<ThingDef Name="Mid" ParentName="Grand" Abstract="True"><label>mid lamp</label></ThingDef>'
            + thing("Leaf", "<texPath>a/b</texPath>", attrs='ParentName="Mid"')
        ),
    },
    "inherit_list": {
        "Defs/All.xml": defs(
            '<RuleDef Name="Base" Abstract="True"><pack><rulesStrings><li>a->parent one</li></rulesStrings></pack></RuleDef>'
            + thing("Leaf", "<pack><rulesStrings><li>b->child two</li></rulesStrings></pack>", "RuleDef", 'ParentName="Base"')
        ),
    },
    "inherit_rules": {
        "Defs/All.xml": defs(
            '<ThingDef Name="Base" Abstract="True"><label>base label</label>'
            "<steps><li>first step</li><li>second step</li></steps>"
            "<stages><li><label>stage one</label><note>kept note</note></li></stages>"
            "<inner><a>deep text a</a><b>deep text b</b></inner>"
            "<many><x>one x</x><x>two x</x><y>only y</y></many></ThingDef>"
            # empty label stays empty; Inherit=False cuts; empty inner takes all
            + thing("Empty", "<label/><inner/>", attrs='ParentName="Base"')
            + thing("Cut", '<steps Inherit="False"><li>own step</li></steps>', attrs='ParentName="Base"')
            + thing("Text", "<inner>plain text</inner>", attrs='ParentName="Base"')
            + thing("Part", "<inner><b>own b</b><c>own c</c></inner><many><x>own x</x></many>", attrs='ParentName="Base"')
            + thing("Alone", "<label>alone lamp</label>", attrs='ParentName="Base" Inherit="False"')
        ),
    },
    "inherit_self": {
        "Defs/All.xml": defs(
            '<ThingDef Name="Me" ParentName="Me"><defName>Me</defName><steps><li>own step</li></steps></ThingDef>'
        ),
    },
    "inherit_cycle": {
        "Defs/All.xml": defs(
            '<ThingDef Name="A" ParentName="B"><defName>DefA</defName><label>label a</label></ThingDef>'
            '<ThingDef Name="B" ParentName="A"><defName>DefB</defName><note>note b</note></ThingDef>'
        ),
    },
    "lists": {
        "Defs/All.xml": defs(
            thing(
                "L",
                "<steps><li>one step</li><!-- no item --><li>42</li><li>three steps</li></steps>"
                "<mixed><li>some item</li><other>other item</other></mixed>"
                "<stages><li><label>stage one</label></li><li><label>stage two</label></li></stages>"
                "<nest><li><li>inner item</li><li>inner more</li></li></nest>"
                "<styles><li>Morbid look</li></styles>",
            )
        ),
    },
    "patches": {
        "Defs/Things.xml": defs(thing("Lamp", "<label>oil lamp</label>")),
        "Patches/P.xml": patch(
            operation("Replace", 'Defs/ThingDef[defName="Lamp"]/label', "<label>patched lamp</label>")
            + operation("Add", '/Defs/ThingDef[defName="Wall"]', "<description>A sturdy wall.</description>")
        ),
    },
    "patch_multi": {
        "Patches/P.xml": patch(
            operation("Add", "Defs/ThingDef[defName=\"Wall\" or defName='Door']", "<description>Shared words here.</description>")
        ),
    },
    "patch_nested": {
        "Patches/P.xml": patch(
            '<Operation Class="PatchOperationFindMod"><mods><li>X</li></mods>'
            '<match Class="PatchOperationSequence"><operations>'
            + operation("Add", 'Defs/ThingDef[defName="Throne"]/building', "<useLabel>use the throne</useLabel>", "li")
            + operation("Insert", 'Defs/ThingDef[defName="Throne"]/stages/li[2]/label', "<label>a label</label>", "li")
            + "</operations></match></Operation>"
        ),
    },
    "patch_skip": {
        "Patches/P.xml": patch(
            operation("Replace", 'Defs/ThingDef[defName="W"]/statBases/Max', "<Max>500</Max>")
            + operation("Add", 'Defs/*[defName="D"]', "<description>Wildcard words.</description>")
            + operation("Add", 'Defs/ThingDef[defName="W"]/comps', "<li><label>listed words</label></li>")
            + operation("Add", 'Defs/ThingDef[defName="W"]/memes/li', "<label>bare words</label>")
        ),
    },
    "patch_whole": {
        "Patches/P.xml": patch(
            operation("Replace", 'Defs/ThingDef[defName="Old"]', "<Ns.NewDef><defName>Fresh</defName><label>fresh words</label></Ns.NewDef>")
        ),
    },
    "patch_order": {
        "Defs/Things.xml": defs(thing("Lamp", "<label>oil lamp</label>")),
        "Patches/a/Same.xml": patch(
            operation("Replace", 'Defs/ThingDef[defName="Lamp"]/label', "<label>first lamp</label>")
            + operation("Add", 'Defs/ThingDef[defName="New"]', "<label>first new</label>")
        ),
        "Patches/b/Other.xml": patch(
            operation("Replace", 'Defs/ThingDef[defName="Lamp"]/label', "<label>other lamp</label>")
            + operation("Add", 'Defs/ThingDef[defName="New"]', "<label>other new</label>")
        ),
        # the stem was first seen before "Other", so this file counts as earlier
        "Patches/c/Same.xml": patch(
            operation("Replace", 'Defs/ThingDef[defName="Lamp"]/label', "<label>same lamp</label>")
        ),
    },
    "line_list": {
        f"{EN}/Strings/Names/First.txt": b"\xef\xbb\xbf// note\nAnna\nBert\n\nCleo\n",
        f"{EN}/Strings/Names/Empty.txt": "// nothing\n\n",
        f"{EN}/Keyed/K.xml": language("<K>some text</K>"),
    },
    "quest": {
        "Defs/Q.xml": defs(
            thing("Q", "<label>quest name</label><text>some words</text><storeAs>siteTile</storeAs>"
                       "<inSignal>site.Entered now</inSignal><moduleTypeID>kitchen part</moduleTypeID>")
        ),
    },
    "malformed": {
        "Defs/Bad.xml": "<Defs><ThingDef>",
        "Defs/Good.xml": defs(thing("Lamp", "<label>good lamp</label>")),
        f"{EN}/Keyed/Bad.xml": "<LanguageData><K>",
        f"{EN}/Keyed/Good.xml": language("<K>good key</K>"),
    },
    "same_name": {
        f"{EN}/DefInjected/ThingDef/T.xml": language("<Twin.label>stale thing</Twin.label>"),
        "Defs/Both.xml": defs(
            thing("Twin", "<label>thing twin</label>") + thing("Twin", "<label>job twin</label>", "JobKind")
        ),
    },
    "bom": {
        f"{EN}/Keyed/K.xml": b"\xef\xbb\xbf" + language("<A>with bom<b>x</b>lost</A>").encode(),
    },
    "german": {
        "Languages/Deutsch/Keyed/K.xml": language("<K>deutscher Text</K>"),
    },
}


def write(root: Path, names: list[str] | None = None) -> list[str]:
    roots = []
    for name in names or PACKAGES:
        for path, body in PACKAGES[name].items():
            target = root / name / path
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(body if isinstance(body, bytes) else body.encode())
        roots.append(str(root / name))
    return roots
