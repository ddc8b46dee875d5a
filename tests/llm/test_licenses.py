"""Files with several licences."""

from quillstream.llm import licenses
from tests.llm import cases

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted."
GPL = "This work is licensed under the GNU General Public License version 3."
CC = "Licensed under CC BY 4.0"


def test_every_licence_of_a_file_is_named(spark):
    several = {1: (BSD, CC), 2: (MIT, BSD, GPL), 3: (GPL, CC, MIT, BSD, "Released under the MIT license."), 4: (CC,)}
    rows = [(k, "Some words before. " + " And then other words. ".join(parts), "en", "s", 0) for k, parts in several.items()]
    rows += [(100 + k, f"licensed under version 3 of this work, general public {k}", "en", "s", 0) for k in range(40)]  # makes their words common
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(cases.frame(spark, rows)).collect()}
    assert {k: got[k] for k in several} == {1: "bsd,cc-by", 2: "bsd,gpl-3,mit", 3: "bsd,cc-by,gpl-3,mit", 4: "cc-by"}
    assert not any(got[100 + k] for k in range(40))
