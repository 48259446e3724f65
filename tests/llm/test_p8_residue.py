"""Problem 8: residue is found in whole texts and in single sections, mentions of it are not."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from tessera.llm import residue  # noqa: E402

CONTENT = "We collected 10,844 tokens from reader forums between 2012 and 2005. Names of private persons were replaced before the release."


@pytest.mark.parametrize(
    "text",
    [
        "404 Not Found\n\nThe requested URL /abs/2306.139189 could not be served.\n\ndataharbor.example at port 443",
        f"# Set\n\n{CONTENT}\n\n## Introduction\n\n[insert introduction]\n",
        f"\\begin{{abstract}}\nLorem ipsum dolor sit amet corda velum.\n\\end{{abstract}}\n\\section{{Introduction}}\n{CONTENT}\n\\end{{document}}",
        f"A set\n\nAbstract\n{CONTENT}\n\n1 Introduction\nSection text pending; the editor will sup\u200bply it.\n7",
        "Для просмотра этой страницы включите JavaScript в браузере.",
    ],
)
def test_residue(text):
    assert residue.is_residue(text)


@pytest.mark.parametrize(
    "text",
    [
        None,
        " \n",
        CONTENT,
        "# Set\n\nDuring cleaning we dropped pages whose text was only '404 Not Found' or 'Please enable JavaScript', 15 pages in all.",
        "# Set\n\nA template such as `{{ user }} said {{ quote }}` was rendered 1444 times with names from a list.",
    ],
)
def test_content(text):
    assert not residue.is_residue(text)


def test_queries_are_registered():
    from tessera.llm.queries import QUERIES

    assert {"p8_found", "p8_corpus"} <= QUERIES.keys()
