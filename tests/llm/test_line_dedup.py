from lexiflow.llm.line_dedup import boilerplate_lines, remove_spread_lines

SCHEMA = "doc_id long, text string, source string, line string, site string"


def brute_force(rows, min_sites):
    sites, first = {}, {}
    for n, (doc_id, text, source, *_) in enumerate(rows):
        for at, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                sites.setdefault(line.strip(" "), set()).add(source)
                place = (doc_id is None, doc_id or 0, at)
                first[line.strip(" ")] = min(first.get(line.strip(" "), place), place)
    out = []
    for doc_id, text, *_ in rows:
        if text is None:
            out.append((doc_id, 0, 0, None))
            continue
        lines = text.split("\n")
        drop = [
            bool(x.strip(" ")) and len(sites[x.strip(" ")]) >= min_sites and first[x.strip(" ")] != (doc_id is None, doc_id or 0, at)
            for at, x in enumerate(lines)
        ]
        kept = "\n".join(x for x, d in zip(lines, drop) if not d)
        out.append((doc_id, sum(bool(x.strip(" ")) for x in lines), sum(drop), kept))
    return sorted(out, key=str)


def result(spark, rows, min_sites):
    cleaned = remove_spread_lines(spark.createDataFrame(rows, SCHEMA), min_sites)
    return sorted((tuple(r) for r in cleaned.select("doc_id", "n_lines", "n_removed", "text").collect()), key=str)


def test_agrees_with_counting_all_sites(spark):
    rows = []
    for i in range(200):  # line k is on k sites
        lines = [f"own {i}"] + [f"shared {k}" for k in range(1, 16) if i % 20 < k] + ["", f"own {i} again"]
        rows.append((i, "\n".join(lines), f"s{i % 20}", "x", "y"))
    for min_sites in (1, 3, 6, 15):
        assert result(spark, rows, min_sites) == brute_force(rows, min_sites)


def test_one_line_in_all_documents(spark):
    rows = [(i, f"hot line\nbody {i}", f"s{i % 7}", "x", "y") for i in range(1000)]
    got = result(spark, rows, 6)
    assert got == brute_force(rows, 6) and sum(r[2] for r in got) == 999


def test_odd_rows(spark):
    rows = [(i, "a\na\n b ", None if i == 3 else f"s{i}", None, None) for i in range(6)]
    rows += [(7, None, "s", None, None), (8, "", None, None, None), (None, "a", "s0", None, None), (9, "\n\n \n", "s", None, None)]
    rows += [(10, "c\n" * 50_000, "s", None, None)]
    assert result(spark, rows, 6) == brute_force(rows, 6)
    twice = [(1, "a\nq", "s1", None, None)] * 2 + [(i, "a", f"s{i}", None, None) for i in range(2, 8)]
    assert [r[2:] for r in result(spark, twice, 6) if r[0] == 1] == [(0, "a\nq")] * 2
    assert result(spark, [], 6) == []


def test_threshold_is_exact_for_wide_lines(spark):
    rows = [(i, f"just under\n{'at it' if i < 300 else i}", f"s{i % 299 if i >= 300 else i}", "", "") for i in range(300)]
    rows = [(i, "at it" + ("\nunder" if i < 299 else ""), f"s{i}", "", "") for i in range(300)]
    found = boilerplate_lines(spark.createDataFrame(rows, SCHEMA), 300)
    assert found.count() == 1


def test_columns_of_the_user_stay(spark):
    docs = spark.createDataFrame([(1, "a\nb", "s", 5, 6, 7)], "doc_id long, text string, source string, drop int, drop_row int, _row int")
    row = remove_spread_lines(docs).first()
    assert (row["drop"], row["drop_row"], row["_row"], row["n_lines"], row["n_removed"]) == (5, 6, 7, 2, 0)
