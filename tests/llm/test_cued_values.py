"""Personal data: values behind seed cues are found whole, whatever their characters."""

from plumbline.llm import personal_data
from plumbline.llm.common import import_path

BASE64 = "q83/Zm9v+YmFy/c2VjcmV0+Kz09=="
CASES = [
    ("password: correcthorse and more", "correcthorse"), ("pwd=ab1", "ab1"), ('secret = "two words, 1 quote" x', "two words, 1 quote"),
    (f"api_key={BASE64} tail", BASE64), (f"see http://h/?token={'z' * 9}&user=bob now", "z" * 9),
    ("token: hunter!.", "hunter!"), ("url: password=p/w+d", "p/w+d"), (f'<a href="x?token=ab/cd">', "ab/cd"),
]
OTHERS = ["note: correctwords and more", "a plain sentence: nothing here", "std::vector x == y", "", "key:" * 3000]


def test_cued_values_are_found_whole(spark):
    import_path(spark)
    texts = [t for t, _ in CASES] + OTHERS
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["row"]["doc_id"]: [texts[r["row"]["doc_id"]][x["start"]:x["end"]] for x in r["spans"]]
           for r in personal_data.find_personal_data(docs).collect()}
    assert [got[i] for i in range(len(CASES))] == [[want] for _, want in CASES]
    assert all(got[i] == [] for i in range(len(CASES), len(texts)))
