"""Fixed values of the language rules: character classes, kana tables and word lists."""

from __future__ import annotations

# Character classes (regular-expression class bodies; \x{...} for Java).
HIRAGANA = "ぁ-ゟ"
KATAKANA = "ァ-ヺーヽヾ"
KANJI = "々一-鿿豈-﫿\U00020000-\U0002ffff"
LINE_JAPANESE = "ぁ-ゟァ-ヺ々一-鿿"  # the class of the line filter: narrower than the two above
ASCII_WORD = r"[A-Za-z][A-Za-z0-9_+#.\-]*"

# Kana of the five vowels after each consonant (a i u e o; blank: none).
GOJUON = {
    "": "あ い う え お",
    "k": "か き く け こ",
    "g": "が ぎ ぐ げ ご",
    "s": "さ し す せ そ",
    "z": "ざ じ ず ぜ ぞ",
    "t": "た てぃ つ て と",
    "d": "だ でぃ どぅ で ど",
    "n": "な に ぬ ね の",
    "h": "は ひ ふ へ ほ",
    "b": "ば び ぶ べ ぼ",
    "p": "ぱ ぴ ぷ ぺ ぽ",
    "m": "ま み む め も",
    "y": "や - ゆ - よ",
    "r": "ら り る れ ろ",
    "w": "わ ゐ - ゑ を",
    "v": "ゔぁ ゔぃ ゔ ゔぇ ゔぉ",
    "f": "ふぁ ふぃ ふ ふぇ ふぉ",
    "wh": "うぁ うぃ - うぇ うぉ",
}
# Leads of contracted sounds, which small vowels follow.
CONTRACTED = {
    "ky": "き", "gy": "ぎ", "sh": "し", "sy": "し", "j": "じ", "zy": "じ",
    "ch": "ち", "ty": "ち", "cy": "ち", "dy": "ぢ", "ny": "に", "hy": "ひ",
    "by": "び", "py": "ぴ", "my": "み", "ry": "り", "fy": "ふ", "vy": "ゔ",
}
SMALL = {"a": "ゃ", "i": "ぃ", "u": "ゅ", "e": "ぇ", "o": "ょ"}
# Spellings outside the two rules.
IRREGULAR = {
    "shi": "し", "chi": "ち", "tsu": "つ", "ji": "じ", "n": "ん",
    "kwa": "くぁ", "gwa": "ぐぁ",
    "dzu": "づ", "dzi": "ぢ", "dji": "ぢ", "dja": "ぢゃ", "dju": "ぢゅ", "djo": "ぢょ",
    "~tsu": "っ", "~tu": "っ", "~ya": "ゃ", "~yu": "ゅ", "~yo": "ょ",
    "~a": "ぁ", "~i": "ぃ", "~u": "ぅ", "~e": "ぇ", "~o": "ぉ",
    "~wa": "ゎ", "~ka": "ゕ", "~ke": "ゖ",
}


def romaji_table() -> dict[str, str]:
    """Kana of each romaji syllable, by rule."""
    table = {c + v: kana for c, row in GOJUON.items() for v, kana in zip("aiueo", row.split(), strict=True) if kana != "-"}
    for lead, kana in CONTRACTED.items():
        for vowel, small in SMALL.items():
            table.setdefault(lead + vowel, kana + small)
    return table | IRREGULAR


# How the letters and digits of an acronym are read.
LETTERS = {
    "a": "えー", "b": "びー", "c": "しー", "d": "でぃー", "e": "いー", "f": "えふ",
    "g": "じー", "h": "えいち", "i": "あい", "j": "じぇー", "k": "けー", "l": "える",
    "m": "えむ", "n": "えぬ", "o": "おー", "p": "ぴー", "q": "きゅー", "r": "あーる",
    "s": "えす", "t": "てぃー", "u": "ゆー", "v": "ぶい", "w": "だぶりゅー",
    "x": "えっくす", "y": "わい", "z": "ぜっと",
    "0": "ぜろ", "1": "いち", "2": "に", "3": "さん", "4": "よん",
    "5": "ご", "6": "ろく", "7": "なな", "8": "はち", "9": "きゅう",
}

# Known spellings, by their lower-case form.
CANONICAL = {
    "github": "GitHub", "gitlab": "GitLab", "youtube": "YouTube", "javascript": "JavaScript",
    "typescript": "TypeScript", "nodejs": "Node.js", "postgresql": "PostgreSQL", "mysql": "MySQL",
    "sqlite": "SQLite", "latex": "LaTeX", "luatex": "LuaTeX", "bibtex": "BibTeX", "pyside": "PySide",
    "numpy": "NumPy", "scipy": "SciPy", "matplotlib": "Matplotlib", "pytorch": "PyTorch",
    "openai": "OpenAI", "macos": "macOS", "iphone": "iPhone", "ipad": "iPad", "ios": "iOS",
    "ffmpeg": "FFmpeg", "obsidian": "Obsidian", "notion": "Notion", "dropbox": "Dropbox",
    "whisper": "Whisper",
}

# Common English words.
COMMON_ENGLISH = frozenset(
    """
    about after again also and any are because been before both but can cannot check code could data
    does done each else error file files first for from get give has have here how info into just
    like list make more most much must need new not now one only other out over please same see
    should show some such text than that the their them then there these they this those time two
    use used using very want was well were what when where which while who why will with would
    you your
    add all already always another back build cancel change clear close complete copy create current
    default delete download downloading edit end example failed false find finish found full help high
    input install item keep key last left level line load log long look loop low main menu message
    mode move name next none note null number off open option order output page part pasted path
    process read ready region remove rename reset result right run save search select set size skip sort
    source start state status step stop success support system table target task test top total traceback
    true try type update user value view wait warning width write yes
    """.split()
)

# Affixes and formal nouns that are no words by themselves.
AFFIXES = frozenset(
    """
    的 化 性 者 用 目 個 型 版 系 上 中 下 前 後 内 外 間 側 数 度 分 回 本
    無 未 再 各 全 半 約 超 最 第 数個 など 等 及び 且つ ため こと もの とき
    """.split()
)

# Common words of three characters or more. Shorter ones never reach the default least
# length; whoever lowers it gives them as a parameter, see ``StopWords.read``.
COMMON_JAPANESE = frozenset(
    """
    不具合 command 大丈夫 小文字 日本語 model space 立ち上げ 見出し 使い方 問い合わせ 大きさ backup 見た目 影響力 端末機
    区切り 取り込み 度合い 書き出し 生成物 male 繰り返し west 見込み 読み込み 関数名 アイコン アクセス アップ アドレス アプリ
    アルゴリズム アルバム インストール インデックス インデント インポート ウィンドウ エクスポート エラー オプション カテゴリ クラス グラフ グループ
    コード コマンド コメント コンテンツ コンパイル サイズ サポート サンプル シート システム ショート スクリプト スタイル ストリーム スペース
    スライド セクション ソース ソート ターミナル タイトル タイプ ダイアログ データ ディレクトリ テキスト テスト デフォルト テンプレート デバッグ
    ドキュメント トラック ネット ノート バージョン パターン パラメータ パラメーター ハンドル バッファ ビュー ファイル フォルダ フォーマット
    フォント ブラウザ ブロック プログラム プロジェクト プロセス プロパティ ヘッダ ヘッダー ページ ボタン ポイント メソッド メッセージ メニュー
    メモリ モジュール モデル ユーザ ユーザー ライブラリ リスト リンク ルール レイアウト レコード レベル レポート ワード アップデート アプローチ
    インターフェース インタフェース エラーメッセージ カスタム カレント カレントディレクトリ クリック ケース コスト コンテキスト サーバ サーバー
    サービス シーン スイッチ スクロール ステップ セット セッション タイミング ダウンロード チェック チーム ツール ディスク デバイス トップ
    ドメイン ネットワーク パーセント バックアップ バランス パフォーマンス ビット ファイル名 フォルダー フロー プラン プレビュー ヘルプ ポート
    マシン メイン モード ライン リクエスト リポジトリ リリース ルート レスポンス ロジック ワーク ワークフロー エンジニアリング リファクタリング
    可能性 最終的 原理的 構造化 具体的 基本的 一般的 効率的 自動的 前提条件 相対的 絶対的 論理的 物理的 実質的 部分的 全面的 段階的 継続的
    定期的 個人的 直感的 客観的 主観的 アーキテクチャ アカウント アップロード アプリケーション ウィジェット オリジナル オーバーレイ カメラ カラー
    カラム カーソル キャンセル クライアント クリーン コピー コントロール コマンドライン サイト サイン ステータスバー ステレオ スケール センサー
    ダブルクリック チェックボックス デザイン デプロイ トグル トークン ドラッグ ドロップ ハイフン パスワード ビルド フィードバック フレームワーク
    プッシュ プラットフォーム プロンプト ベース ベストプラクティス ページャ マイク マウス マクロ マージ マニュアル ミッション メンバー リモート
    レイヤー ローカル ログイン ループ 世の中 良い感じ 文字程度 使用可能 同程度 行う必要 考え方 管理者 拡張子 構造的 現実的 全般的 価値観 積極的
    可視化 自動化 再利用 再現性 副作用 表示領域 設定ファイル 音声ファイル 動画ファイル
    """.split()
) | frozenset("設定 確認 修正 作成 追加 変更 削除 実装 処理 機能 画面 表示 一覧 結果 問題 対応 必要".split())
