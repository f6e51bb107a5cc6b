from millrace.operators import language

EN, FR = "the cat is in the house and the dog was with the people of the town ", "le chat est dans la maison et les gens de la ville sont avec le chien "


def test_language(spark):
    rows = [(i, (EN if i % 2 else FR) * 2 + str(i), "en" if i % 2 else "FR-fr") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    model = language.train(df.where("id < 20"))
    assert set(model) == {"en", "fr"} and all(len(v) <= language.TRIPLES + 1 for v in model.values())
    held = df.where("id >= 20").select("id", language.identify("text", model).alias("l"), language.in_language("text", model).alias("e")).collect()
    assert all(r["l"]["lang"] == ("en" if r["id"] % 2 else "fr") and r["e"] == bool(r["id"] % 2) for r in held)
    odd = spark.createDataFrame([(None,), ("short",)], "text string").select(language.identify("text", model).alias("l"), language.in_language("text", model).alias("e")).collect()
    assert all(r["l"]["lang"] is None and not r["e"] for r in odd)
    assert language.train(df.limit(0)) == {}
