from threshline.llm import decontam

ITEM = "A train leaves Paris at 9 and travels 120 km in 2 hours before it stops. How far does the train travel if it keeps the speed for 5 hours more on the same line?"
SAME = "Earlier text here. " + ITEM + " And later text."
OTHER = "well " + ITEM.replace("Paris", "New Delhi").replace("120", "400").replace("2 hours", "3 hours").replace("5", "7")
BROKEN = "The sum of 4 and 4 gives the side of the square field in the old book."
ITEM2 = "The sum of 3 and 3 gives the side of the square field in the old book."
BAD2 = ITEM2.replace("3 and 3", "3 and 5")


def hits(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, item int")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.k1 if r.k1 is not None else -1, r.item, r.exact) for r in decontam.leaks(d, b).collect())


def test_templates():
    codes, slots, _ = decontam.template("He met John Smith and 12 kg. Ann saw 3,5 km")
    assert slots.tolist() == [False, False, True, False, True, True, False, False, True, True]
    assert len(decontam.template("")[0]) == 0


def test_same_and_reparameterised_items_are_found(spark):
    docs = [(1, SAME, 0), (2, OTHER, 0), (3, "quite another text about trains and stops " * 20, 0), (4, None, 0), (5, "", 0), (None, SAME, 0), (6, BROKEN, 0), (7, BAD2, 0), (8, ITEM[: len(ITEM) // 2], 0), (9, "word " * 30000 + ITEM, 0), (1, SAME, 0)]
    items = [(10, ITEM), (11, ITEM2), (12, None), (13, ""), (14, "two words"), (15, "12 13 14 15 16 17"), (10, ITEM)]
    assert hits(spark, docs, items) == [(-1, 10, True), (1, 10, True), (2, 10, False), (6, 11, False), (9, 10, True)]


def test_an_inserted_word_does_not_hide_an_item(spark):
    w = ITEM.split()
    assert hits(spark, [(1, " ".join([*w[:15], "really", *w[15:]]), 0)], [(1, ITEM)]) == [(1, 1, True)]


def test_short_items_match_whole(spark):
    assert hits(spark, [(1, "see the red fox now", 0), (2, "the red dog", 0)], [(1, "the red fox")]) == [(1, 1, True)]


def test_the_filter_keeps_clean_documents_and_columns(spark):
    d = spark.createDataFrame([(1, SAME, 0), (2, "clean text", 0), (3, None, 0), (None, "clean", 1)], "doc_id long, text string, _k1 int")
    b = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = decontam.decontaminate(d, b)
    assert got.columns == d.columns and sorted(str(r.doc_id) for r in got.collect()) == ["2", "3", "None"]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(d, empty).count() == 4
    assert decontam.decontaminate(d.limit(0), b).count() == 0


STORY = "Natalia sold clips to 48 of her friends in the spring. Natalia then sold half as many clips in the month of May. How many clips did Natalia sell in both months together?"
PAGES = "James writes 3 pages to each of 2 different friends. James does it twice a week. How many pages does he write in a year?"
MARBLES = "Tom has 5 red marbles. Anna has 3 more marbles than he has. Peter has twice as many as they have together. How many marbles do all of them have?"
POINTS = "The points A and B lie on a line with a distance of 12 km. Find how far A is from the middle of the line."


def test_names_that_begin_sentences(spark):
    docs = [(1, "Some words first.\n" + STORY.replace("Natalia", "Kofi").replace("48", "31"), 0), (2, PAGES.replace("James", "Mary Ann").replace("3", "9"), 0), (3, "Question: " + MARBLES.replace("Tom", "Li").replace("Anna", "Eva").replace("Peter", "Omar"), 0), (4, POINTS.replace("A ", "P ").replace("B ", "Q "), 0), (5, "Yesterday " + STORY, 0)]
    docs += [(6, STORY.replace("Natalia then", "Peter then").replace("Natalia", "Kofi"), 0), (7, "Anna walks home. Peter has twice as much work. How many people are in all of them?", 0)]
    items = [(1, STORY), (2, PAGES), (3, MARBLES), (4, POINTS)]
    assert hits(spark, docs, items) == [(1, 1, False), (2, 2, False), (3, 3, False), (4, 4, False), (5, 1, True)]


def test_short_items_after_a_colon(spark):
    docs = [(1, "Answer: The red fox", 0), (2, "The answer is: Where did they go then", 0), (3, "Answer: The red dog", 0)]
    assert hits(spark, docs, [(1, "The red fox"), (2, "Where did they go")]) == [(1, 1, True), (2, 2, True)]


def test_a_changed_first_word_costs_its_windows_only(spark):
    item = "This long train goes to the coast each day with many people who like to see the water and the hills. This slow train stops at each small place on its way."
    assert hits(spark, [(1, item.replace("This long", "That long"), 0)], [(1, item)]) == [(1, 1, True)]
